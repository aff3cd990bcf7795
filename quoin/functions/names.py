"""Fields of item names of the form printer_id_library_format_bookYEAR[P]-page_page1rLINE_charSLOT_L_uc.tif, as native columns.

Nothing raises: a field that a name lacks is null, or -1 where the field has a number by convention.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _token(name: Column, i: int) -> Column:
    return F.get(F.split(name, "_", -1), F.lit(i))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def printer(name: Column) -> Column:
    return _token(name, 0)


def catalogue_id(name: Column) -> Column:
    return _token(name, 1)


def year(name: Column) -> Column:
    return F.right(F.split_part(name, F.lit("-"), F.lit(1)), F.lit(4)).try_cast("int")


def book(name: Column) -> Column:
    """Last token before the first hyphen without one trailing capital."""
    return F.regexp_replace(F.element_at(F.split(F.split_part(name, F.lit("-"), F.lit(1)), "_"), -1), "[A-Z]$", "")


def book_without_redo(name: Column) -> Column:
    return F.replace(book(name), F.lit("REDO"), F.lit(""))


def book_by_position(name: Column) -> Column:
    """Fifth token up to its hyphen; the text None if that token holds .jpg."""
    token = _token(name, 4)
    return F.when(token.contains(".jpg"), "None").otherwise(F.split_part(token, F.lit("-"), F.lit(1)))


def _number(token: Column) -> Column:
    return F.coalesce(token.try_cast("int"), F.lit(-1))


def page(name: Column) -> Column:
    return _number(F.split_part(F.split_part(name, F.lit("-"), F.lit(2)), F.lit("_"), F.lit(1)))


def line(name: Column) -> Column:
    return _number(F.replace(_token(name, 5), F.lit("page1rline"), F.lit("")))


def slot(name: Column) -> Column:
    return _number(F.replace(_token(name, 6), F.lit("char"), F.lit("")))


def letter(name: Column) -> Column:
    """The letter before the first _uc or _lc."""
    return F.nullif(F.regexp_extract(name, "([A-Za-z])_[ul]c", 1), F.lit(""))


def parent_name(path: Column) -> Column:
    """The folder that holds the file; empty if there is none."""
    return F.regexp_extract(path, "([^/]*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def letter_class(path: Column) -> Column:
    """The character before the first _uc of the name; else the folder if the path holds `letters`; else the character before the first dot of a name without uc; else null."""
    name = base_name(path)
    return (
        F.when(name.contains("_uc"), last_character(F.regexp_extract(name, "(?s)^(.*?)_uc", 1)))
        .when(path.contains("letters"), parent_name(path))
        .when(~name.contains("uc") & name.contains("."), last_character(F.regexp_extract(name, r"(?s)^([^.]*)\.", 1)))
    )


def last_character(text: Column) -> Column:
    return F.nullif(F.right(text, F.lit(1)), F.lit(""))


def graph_letter(path: Column) -> Column:
    """The folder of a chunk, else the eighth token; null unless its capitals stand in a row in the alphabet (the empty text does)."""
    token = F.when(path.contains("chunk"), parent_name(path)).otherwise(_token(base_name(path), 7))
    return F.when(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.upper(token)) > 0, token).when(token == "", token)


def chunk_number(path: Column) -> Column:
    return F.split_part(F.element_at(F.split(base_name(path), "_"), -1), F.lit("."), F.lit(1)).try_cast("int")


def folio_part(page: Column) -> Column:
    """1 up to page 292, 2 up to 620, 3 beyond; page: its first four characters count."""
    n = F.substring(page, 1, 4).try_cast("int")
    return F.when(n <= 292, 1).when(n <= 620, 2).when(n >= 621, 3)


def damage_place(name: Column) -> Column:
    """[x, y] of _x.._y.., or [-1, -1]."""
    pattern = r"_x(\d+)_y(\d+)"
    at = lambda i: F.regexp_extract(name, pattern, i).try_cast("int")
    return F.when(name.rlike(pattern), F.array(at(1), at(2))).otherwise(F.array(F.lit(-1), F.lit(-1)))


def _digits(text: Column) -> Column:
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def _small_letters(text: Column) -> Column:
    return (text != "") & (F.translate(text, "abcdefghijklmnopqrstuvwxyz", "") == "")


def perturbation(name: Column) -> Column:
    """stamp, kind, timestamp, damages, global_ink, local_ink of a perturbed item's name; of an original without the last three; null fields for other names.

    Names are taken apart at the words that mark their parts: up to perturb the stamp, then number, kind and time, then what damages there are and the two inks.
    """
    damage, inks, original = "_damage_", "_globalink_", "_original.tif"
    at = F.instr(name, damage)
    head = F.when(at > 0, F.left(name, at - 1)).when(name.endswith(original), F.left(name, F.length(name) - len(original)))
    stamp_end = F.instr(head, "_perturb") + len("_perturb") - 1
    code = F.split(F.substr(head, stamp_end + 1), "_")
    known = (stamp_end >= len("_perturb")) & (F.size(code) == 3) & _digits(F.get(code, 0)) & _small_letters(F.get(code, 1)) & _digits(F.get(code, 2))
    tail = F.split_part(name, F.lit(inks), F.lit(-1))
    ink = F.split(tail, "_")
    inked = name.contains(inks) & (F.size(ink) == 4) & _small_letters(F.get(ink, 0)) & (F.get(ink, 1) == "localink") & _small_letters(F.get(ink, 2)) & F.get(ink, 3).isin("1.tif", "2.tif")
    start = at + len(damage)
    damages = F.substr(name, start, F.length(name) - F.length(tail) - len(inks) - start + 1)
    whole = F.when(at > 0, inked & (damages != "")).otherwise(F.lit(True))
    field = lambda c: F.when(known & whole, c)
    of_damage = lambda c: F.when(known & whole & (at > 0), c)
    return F.struct(
        field(F.left(head, stamp_end)).alias("stamp"), field(F.get(code, 1)).alias("kind"), field(F.get(code, 2).try_cast("long")).alias("timestamp"),
        of_damage(F.split(damages, "_")).alias("damages"), of_damage(F.get(ink, 0)).alias("global_ink"), of_damage(F.get(ink, 2)).alias("local_ink"),
    )


def perturbation_tokens(name: Column) -> Column:
    """id and timestamp by place (tokens 9 and 11), null for names of fewer than 12 tokens."""
    enough = F.size(F.split(name, "_", -1)) >= 12
    return F.struct(F.when(enough, _token(name, 9)).alias("id"), F.when(enough, _token(name, 11)).alias("timestamp"))


def composite(*parts: Column) -> Column:
    """All parts in a row; null if any is."""
    return F.concat(*[p.cast("string") for p in parts])


def first_rule(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first rule whose word the text holds (A-Z lower-cased), else the default."""
    out = default
    for word, value in reversed(rules):
        out = F.when(F.lower(text).contains(word), value).otherwise(out)
    return out


def standard_book(book: Column, names: dict[str, str]) -> Column:
    """The standard name of a book by its lower-cased one; others stay."""
    out = book
    for known, standard in names.items():
        out = F.when(F.lower(book) == known, standard).otherwise(out)
    return out


def two_digits(n: Column) -> Column:
    """n with a zero before a single digit; longer numbers stay."""
    text = n.cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def level(value: Column, levels: list[str]) -> Column:
    """The place of the value among the levels; an unknown value raises, null stays."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, v in enumerate(levels):
        out = out.when(value == v, i)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown level "), value)).cast("int"))


def gathering_key(signature: Column) -> Column:
    """What gatherings sort by: (category, letters, number). Lower case comes first (0), then one, two, three capitals (1 to 3), one or two capitals with a number (4, 5), other capitals (6), anything else (999)."""
    capitals, number = F.regexp_extract(signature, "^([A-Z]+)([0-9]*)$", 1), F.regexp_extract(signature, "^([A-Z]+)([0-9]*)$", 2)
    n = F.length(capitals)
    category = F.when(signature.rlike("^[a-z]+$"), 0).when(n == 0, 999).when((number == "") & (n <= 3), n).when((number != "") & (n <= 2), n + 3).otherwise(6)
    return F.struct(category.cast("int").alias("category"), F.when(n > 0, capitals).otherwise(signature).alias("letters"), F.coalesce(number.try_cast("long"), F.lit(0).cast("long")).alias("number"))


def moved_path(path: Column, marker: str, old: str, new: str) -> Column:
    """The path under another root if it holds the marker."""
    return F.when(path.contains(marker), F.replace(path, F.lit(old), F.lit(new))).otherwise(path)


def workbench_fields(name: Column) -> Column:
    """letter, page, line, slot of names such as 'F_uc - (1) Title p. 84-s l. 35 c. 2.jpg'; null where a field is missing."""
    after = lambda mark: F.nullif(F.regexp_extract(name, rf"(?:^|\s){mark}\.\s+(\S+)", 1), F.lit(""))
    return F.struct(F.nullif(F.substring(F.ltrim(name), 1, 1), F.lit("")).alias("letter"), F.replace(after("p"), F.lit("-s"), F.lit("")).alias("page"), after("l").alias("line"), F.replace(after("c"), F.lit(".jpg"), F.lit("")).alias("slot"))


def listed_page(name: Column) -> Column:
    """The number after the first hyphen that has one, else after 'p. '."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"-(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"p\. (\d+)", 1), F.lit(""))).try_cast("int")


def year_past_part(name: Column) -> Column:
    """Like year(), but skips one trailing capital of the part."""
    return F.coalesce(year(name), F.right(F.regexp_replace(F.split_part(name, F.lit("-"), F.lit(1)), "[A-Z]$", ""), F.lit(4)).try_cast("int"))


def book_by_title(name: Column) -> Column:
    """Fifth token up to its hyphen without REDO and dots; else the third and fourth words in lower case, joined by _; else unknown."""
    token, words = _token(name, 4), F.split(F.trim(name), r"\s+")
    titled = F.when(F.size(words) >= 4, F.lower(F.concat_ws("_", F.get(words, 2), F.get(words, 3))))
    return F.when(token.isNotNull(), F.replace(F.replace(F.split_part(token, F.lit("-"), F.lit(1)), F.lit("REDO"), F.lit("")), F.lit("."), F.lit(""))).otherwise(F.coalesce(titled, F.lit("unknown")))


def book_by_pattern(name: Column) -> Column:
    """The book and year of a whole .tif name; null for names of another form."""
    return F.nullif(F.regexp_extract(name, r"^[^_]+_[^_]+_[^_]+_[^_]+_([^-_]+?[0-9]{4})[A-Z]?-[^_]+_.*\.tif$", 1), F.lit(""))


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def filled(first: Column, second: Column) -> Column:
    """first, or second where that is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def is_missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def paragraph_groups(text: Column, after: Column | None = None) -> Column:
    """(group, line) of the lines of a text in which blank lines part groups; explode it with inline. Groups count from 0, or on from `after`, the largest number in use."""
    first = F.lit(0) if after is None else after + 1
    groups = F.filter(F.split(text, r"\n\s*\n"), lambda g: F.trim(g) != "")
    lines = F.transform(groups, lambda g, i: F.transform(F.filter(F.split(g, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct((i + first).cast("int").alias("group"), F.trim(x).alias("line"))))
    return F.flatten(lines)


def picture_groups(text: Column) -> Column:
    """(group, place, file) of the files that \\includegraphics names in each row of a LaTeX table; place 0 is the group's root; explode it with inline."""
    rows = F.transform(F.split(text, r"\\\\"), lambda r: F.regexp_extract_all(r, F.lit(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1)))
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    return F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda f, j: F.struct(i.alias("group"), j.alias("place"), f.alias("file")))))
