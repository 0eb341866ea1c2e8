"""SQL text as Column expressions: comments, literals, fingerprints, evidence and DDL names. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SINGLE = r"'(?:[^'\\]|\\.|'')*+(?:'|\z)"
_DOUBLE = r'"(?:[^"]|"")*+(?:"|\z)'
_TICKED = r"`[^`]*+(?:`|\z)"
_QUOTED = f"(?:{_SINGLE}|{_DOUBLE}|{_TICKED})"
_LINE = r"(?:--(?=[ \t])|#(?!\{))[^\n\x01]*+"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
#: Blanks as the web's regular expressions know them.
BLANKS = "\t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def _column(sql: Column | str) -> Column:
    return F.col(sql) if isinstance(sql, str) else sql


def single_blanks(text: Column) -> Column:
    """Every run of blanks as one space."""
    return F.regexp_replace(F.translate(text, BLANKS, " " * len(BLANKS)), "  ++", " ")


def strip_comments(sql: Column | str) -> Column:
    """Block comments become a blank, line comments go; quoted text stays. `#{` begins a bind parameter, not a comment. A text without any sign that begins a comment is not looked through."""
    plain = F.replace(_column(sql), F.lit("\x01"), F.lit(""))
    marked = F.regexp_replace(plain, f"(?s)({_QUOTED}|{_LINE})|{_BLOCK}", "$1\x01")
    marked = F.regexp_replace(marked, f"(?s)({_QUOTED}|{_LINE})\x01", "$1")
    bare = F.regexp_replace(F.translate(marked, "\x01", " "), f"(?s)({_QUOTED})|{_LINE}", "$1")
    return F.when(_column(sql).rlike(r"--|#|/\*"), bare).otherwise(plain)


def mask_literals(sql: Column | str) -> Column:
    """Strings and numbers become ?; digits that belong to an identifier stay; a sign belongs to the number after an operator, a comma or a parenthesis."""
    number = r"[0-9.]*+(?:[eE][+-]?[0-9]++)?+"
    masked = F.regexp_replace(_column(sql), f"(?s)(?:{_SINGLE}|{_DOUBLE})", "?")
    masked = F.regexp_replace(masked, rf"([=<>(),!+*/-][ \t\r\n]{{0,16}}+)[+-](?=[0-9]){number}", "$1?")
    return F.regexp_replace(masked, rf"(?<![A-Za-z0-9_$])(?=\.?[0-9]){number}", "?")


def fold_in_lists(sql: Column | str) -> Column:
    return F.regexp_replace(_column(sql), r"(?i)\bin\s*+\(\s*+\?(?:\s*+,\s*+\?)*+\s*+\)", "IN (?)")


def fingerprint(sql: Column | str) -> Column:
    """The pattern of a statement: the same for all values of its literals, and for any layout."""
    text = fold_in_lists(mask_literals(strip_comments(sql)))
    text = single_blanks(text)
    text = F.regexp_replace(text, r" ?([(),;=<>!]) ?", "$1")
    text = F.regexp_replace(text, r" +(?=[(),;=<>!])|(?<=[(),;=<>!]) +", "")
    return F.lower(F.trim(F.regexp_replace(text, ";+$", "")))


def one_line(sql: Column | str) -> Column:
    return F.trim(single_blanks(strip_comments(sql)))


def clipped(text: Column | str, most: int = 200) -> Column:
    """At most so many characters, the last an ellipsis where more were there. One expression, so the text is computed once."""
    return F.regexp_replace(_column(text), rf"(?s)^(.{{{most - 1}}}).{{2,}}$", "$1…")


def replaced_once(sql: Column, part: Column, by: Column) -> Column:
    """The statement with the first whole occurrence of a part replaced, blanks of any length being equal. One that begins or ends inside a name or a number is none; without any the replacement stands alone."""
    quoted_part = F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    quoted_part = F.regexp_replace(quoted_part, r"\s+", r"\\E\\s+\\Q")
    edge = r"[\w.$]"
    pattern = F.concat(F.lit(rf"(?s)^(.*?)(?:(?<!{edge})|(?!\w))\Q"), quoted_part, F.lit(rf"\E(?:(?!{edge})|(?<!\w))(.*)$"))
    piece = lambda i: F.call_function("regexp_extract", sql, pattern, F.lit(i))
    return F.when(piece(0) != "", F.concat(piece(1), by, piece(2))).otherwise(by)


def evidence(sql: Column | str, most: int = 200) -> Column:
    return clipped(one_line(sql), most)


def is_dynamic_table(name: Column | str) -> Column:
    """A name that is put together at run time: a placeholder in it, or an open suffix."""
    return _column(name).rlike(r"[?${}]|_$")


def quoted(name: Column | str) -> Column:
    return F.concat(F.lit("`"), _column(name), F.lit("`"))


def index_name(table: Column | str, columns: Column | str) -> Column:
    whole = F.regexp_replace(F.lower(F.concat(F.lit("idx_"), _column(table), F.lit("_"), F.array_join(_column(columns), "_"))), "[^a-z0-9_]", "")
    return F.when(F.length(whole) > 64, F.regexp_replace(F.substring(whole, 1, 64), "_+$", "")).otherwise(whole)


def add_index_ddl(table: Column | str, columns: Column | str, unique: bool = False) -> Column:
    names = F.array_join(F.transform(_column(columns), quoted), ", ")
    return F.concat(F.lit("ALTER TABLE "), quoted(table), F.lit(" ADD UNIQUE INDEX " if unique else " ADD INDEX "), quoted(index_name(table, columns)), F.lit(" ("), names, F.lit(");"))


def index_parts(columns: Column | str) -> Column:
    """An index's parts as text; a part without a column name is an expression."""
    return F.array_join(_column(columns), ", ", "(expression)")


def plain_parts(columns: Column | str) -> Column:
    return F.forall(_column(columns), lambda c: c.isNotNull())


def numeric_literal(text: Column | str) -> Column:
    text = F.trim(_column(text))
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text)


def string_literal(text: Column | str) -> Column:
    """What stands between the quotes of a single string literal, else null."""
    text = F.trim(_column(text))
    body = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(text.rlike(r"(?s)^'(?:''|[^'])*'$"), body).when(text.rlike(r'(?s)^"(?:""|[^"])*"$'), F.replace(body, F.lit('""'), F.lit('"')))


def charset_bytes(charset: Column) -> Column:
    """Bytes of a character in an index key."""
    c = F.coalesce(charset, F.lit("utf8mb4"))
    return F.when(c.startswith("utf8mb4"), 4).when(c.startswith("utf8"), 3).when(c.startswith("latin1") | c.startswith("ascii"), 1).otherwise(4)


# Bytes of a key by column type.
KEY_BYTES = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "integer": 4, "float": 4, "bigint": 8, "double": 8, "datetime": 8, "timestamp": 8, "date": 3, "time": 3, "decimal": 16}
STRING_TYPES = ("varchar", "char", "text", "tinytext", "mediumtext", "longtext", "enum")
UNBOUNDED_TYPES = ("text", "mediumtext", "longtext", "blob", "mediumblob", "longblob", "json")


def key_bytes(kind: Column, length: Column, charset: Column) -> Column:
    """The size of a column in an index key, infinite for types that need a prefix."""
    size = F.lit(8.0)
    for name, n in KEY_BYTES.items():
        size = F.when(kind == name, float(n)).otherwise(size)
    per = charset_bytes(charset)
    size = F.when(kind == "char", F.coalesce(length, F.lit(1)) * per).when(kind.isin("varchar", "varbinary"), F.coalesce(length, F.lit(255)) * per).otherwise(size)
    size = F.when(kind.isin("tinytext", "tinyblob"), F.lit(255.0) * per).otherwise(size)
    return F.when(kind.isin(*UNBOUNDED_TYPES), F.lit(float("inf"))).otherwise(size).cast("double")


def prefix_chars(length: Column, charset: Column, prefix_bytes: int, version: float) -> Column:
    """The length of a prefix index: within the key's budget, no more than 128 and no less than 8 characters."""
    budget = min(3072 if version >= 8 else 767, prefix_bytes)
    by_bytes = F.floor(F.lit(budget) / charset_bytes(charset))
    return F.greatest(F.lit(8), F.least(F.coalesce(length, F.lit(64)), by_bytes, F.lit(128))).cast("long")
