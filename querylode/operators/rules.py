"""The advice: seven rules over buckets, each a projection of array expressions to findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylode.functions import text as T
from querylode.operators.buckets import columns_of
from querylode.scratch import settled

# Names of columns that hold few values, severities, thresholds.
FLAG_NAMES = r"^((is|has|can)_\w*|enabled?|disabled|deleted?|synced?|verified|activated?|expired?|valid|invalid|active|inactive|state|status|type|kind|flag)$"
SEVERITIES = {"info": 0, "warn": 1, "error": 2}
ROW_PRESSURE, HIGH_ROW_PRESSURE = 10_000, 1_000_000
MAX_INDEX_COLUMNS, MAX_COVERING_COLUMNS = 4, 5


@dataclass(frozen=True)
class Options:
    mysql_version: float = 8
    prefix_bytes: int = 3072
    deep_offset: int = 10_000
    min_severity: str = "info"
    rules: tuple[str, ...] | None = None


def _lit(text: str) -> Column:
    return F.lit(text)


def _indexes() -> Column:
    return F.coalesce(F.col("cat.indexes"), F.array().cast("array<struct<name:string,columns:array<string>,unique:boolean,primary:boolean,sub_parts:array<int>>>"))


def _known() -> Column:
    return F.col("cat").isNotNull()


def _column_of(name: Column) -> Column:
    return F.get(F.filter("cat.columns", lambda c: c["name"] == name), F.lit(0))


def _size_of(column: Column) -> Column:
    return T.key_bytes(column["type"], column["length"], F.coalesce(column["charset"], F.col("cat.charset")))


def _starts_with(columns: Column, wanted: Column) -> Column:
    return F.coalesce(F.slice(columns, 1, F.greatest(F.size(wanted), F.lit(1))) == wanted, F.lit(False))


def _has(array: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def _single_pk() -> Column:
    pk = F.get(F.filter(_indexes(), lambda i: i["primary"]), F.lit(0))
    return F.when(F.size(pk["columns"]) == 1, F.get(pk["columns"], F.lit(0)))


def finding(df: DataFrame, rule: str, severity: Column | str, message: Column, ddl: Column | None = None, rewrite: Column | None = None, index_columns: Column | None = None, low_cardinality: Column | None = None, table: str | Column = "table", part: Column | None = None) -> DataFrame:
    strings = "array<string>"
    return df.select(
        _lit(rule).alias("rule"), (severity if isinstance(severity, Column) else _lit(severity)).alias("severity"),
        F.col("parsed.sql").alias("sql"), "fingerprint", "file", "line", "query_time", F.coalesce("rows_examined", "max_rows_examined").alias("rows_examined"), "occurrences", "statement_id",
        (F.col(table) if isinstance(table, str) else table).alias("table"), (ddl if ddl is not None else F.array()).cast(strings).alias("ddl"),
        (rewrite if rewrite is not None else F.lit(None)).cast("string").alias("rewrite"), (index_columns if index_columns is not None else F.lit(None)).cast(strings).alias("index_columns"),
        (low_cardinality if low_cardinality is not None else F.lit(False)).alias("low_cardinality_risk"), message.alias("message"),
        "record_ord", "body_ord", "table_ord", (part if part is not None else F.lit(0)).cast("int").alias("part"),
    )


def missing_index(b: DataFrame, o: Options) -> DataFrame:
    """SIA001. Equality, then grouping and ordering, then one IN list and one range; no advice where an index or key serves already."""
    b = b.where(F.col("parsed.kind").isin("select", "update", "delete"))
    dynamic = b.where(T.is_dynamic_table("table"))
    out = finding(dynamic, "SIA001", "info", F.concat(_lit("The name of table `"), F.col("table"), _lit("` is built at run time, so no single table can be given an index; analyse the real tables' names.")))
    b = b.where(~T.is_dynamic_table("table"))
    split = b.where(F.size("or_branches") > 1)
    branches = F.array_join(columns_of(F.col("or_branches")), ", ")
    out = out.unionByName(finding(split, "SIA001", "info", F.concat(_lit("OR spans different columns ("), branches, _lit("): no single index serves it. Index each branch and look for \"Using union\" in EXPLAIN, or rewrite it as UNION ALL.")), part=F.lit(1)))

    pk = _single_pk()
    b = b.withColumn("pk", pk)
    equal = columns_of(F.filter("equality", lambda r: ~F.coalesce((r["scope"] == "join-on") & (r["column"] == F.col("pk")), F.lit(False))))
    ordered = columns_of(F.concat("grouping", "ordering"))
    b = b.withColumn("eq", equal).withColumn("ord", ordered)
    b = b.withColumn("inl", F.array_except(columns_of(F.col("in_list")), F.col("eq"))).withColumn("rng", F.array_except(columns_of(F.col("ranges")), F.concat("eq", "ord", "inl")))
    wanted = F.slice(F.array_distinct(F.concat("eq", "ord", F.slice("inl", 1, 1), F.slice("rng", 1, 1))), 1, MAX_INDEX_COLUMNS)
    oversized = F.when(_known(), F.transform(F.filter("cat.columns", lambda c: _size_of(c) > o.prefix_bytes / 2), lambda c: c["name"])).otherwise(F.array().cast("array<string>"))
    b = b.withColumn("wanted", wanted).withColumn("dropped", F.array_intersect(F.col("wanted"), oversized)).withColumn("usable", F.array_except("wanted", "dropped"))
    b = b.withColumn("where_eq", columns_of(F.filter("equality", lambda r: r["scope"] != "join-on"))).where(F.size("usable") > 0)
    only = F.when(F.size("usable") == 1, F.get("usable", F.lit(0)))
    served = (
        F.exists(_indexes(), lambda i: _starts_with(i["columns"], F.col("usable")))
        | (F.col("is_driving") & F.coalesce(only == F.col("pk"), F.lit(False)))
        | (~_known() & F.coalesce(only == "id", F.lit(False)))
        | F.exists(_indexes(), lambda i: (i["primary"] | i["unique"]) & (F.size(i["columns"]) == 1) & _has(F.col("where_eq"), F.get(i["columns"], F.lit(0))))
        | F.exists("in_list", lambda r: F.coalesce((r["column"] == F.col("pk")) & (r["op"] == "in"), F.lit(False)))
        | ((F.size("where_eq") > 0) & F.exists(_indexes(), lambda i: _starts_with(i["columns"], F.col("where_eq"))))
    )
    b = b.where(~served)
    prefix = F.get(F.filter(_indexes(), lambda i: F.coalesce(F.get(i["columns"], F.lit(0)) == F.get("usable", F.lit(0)), F.lit(False))), F.lit(0))
    flag = F.forall("usable", lambda c: F.coalesce(_column_of(c)["type"].isin("tinyint", "bit", "boolean", "bool"), F.lit(False)) | c.rlike(FLAG_NAMES))
    b = b.withColumn("prefix", prefix).withColumn("flag", flag)
    severity = F.when(F.col("flag") | ~_known(), "info").when(F.col("prefix").isNotNull(), "warn").otherwise("error")
    message = F.concat_ws(
        " ",
        F.concat(_lit("No index serves this access to "), F.col("table"), _lit("; index (equality, then sort, then range): ("), F.array_join("usable", ", "), _lit(").")),
        F.when(F.col("prefix").isNotNull(), F.concat(_lit("Index "), F.col("prefix.name"), _lit(" ("), T.index_parts(F.col("prefix.columns")), _lit(") covers its beginning only; it may go once the new one is there."))),
        F.when(F.size("dropped") > 0, F.concat(_lit("Left out as too long for a key: "), F.array_join("dropped", ", "), _lit(" (see SIA002)."))),
        F.when(~_known(), _lit("The catalog does not have this table, so existing indexes are unknown.")),
        F.when(F.col("flag"), _lit("All columns hold few values: check COUNT(DISTINCT ...) / COUNT(*) first.")),
    )
    ddl = F.array(T.add_index_ddl("table", "usable"))
    return out.unionByName(finding(b, "SIA001", severity, message, ddl, index_columns=F.col("usable"), low_cardinality=F.col("flag"), part=F.lit(2)))


def prefix_index(b: DataFrame, o: Options) -> DataFrame:
    """SIA002. String columns in predicates that are too long for a key."""
    b = b.where(_known()).select("*", F.posexplode(columns_of(F.concat("equality", "in_list", "ranges"))).alias("part_ord", "col"))
    b = b.withColumn("c", _column_of(F.col("col"))).where(F.col("c").isNotNull() & F.col("c.type").isin(*T.STRING_TYPES, "blob", "mediumblob", "longblob"))
    b = b.withColumn("bytes", _size_of(F.col("c"))).withColumn("blob", F.col("c.type").rlike("text$|blob$"))
    b = b.where(F.col("blob") | (F.col("bytes") > o.prefix_bytes / 2))
    b = b.where(~F.exists(_indexes(), lambda i: F.coalesce((F.get(i["columns"], F.lit(0)) == F.col("col")) & (F.get(i["sub_parts"], F.lit(0)) > 0), F.lit(False))))
    n = T.prefix_chars(F.col("c.length"), F.coalesce("c.charset", "cat.charset"), o.prefix_bytes, o.mysql_version)
    b = b.withColumn("n", n.cast("string")).withColumn("cols", F.array("col"))
    ddl = F.concat(_lit("ALTER TABLE "), T.quoted("cat.name"), _lit(" ADD INDEX "), T.quoted(T.index_name("cat.name", "cols")), _lit(" ("), T.quoted("col"), _lit("("), F.col("n"), _lit("));"))
    probe = F.concat(_lit("SELECT COUNT(DISTINCT LEFT("), F.col("col"), _lit(", "), F.col("n"), _lit(")) / COUNT(DISTINCT "), F.col("col"), _lit(") AS ratio FROM "), F.col("cat.name"), _lit(";"))
    message = F.concat(F.col("cat.name"), _lit("."), F.col("col"), _lit(" is too long for a full index key; index a verified prefix instead. Check it first: "), probe)
    return finding(b, "SIA002", F.when(F.col("blob"), "error").otherwise("warn"), message, F.array(ddl), index_columns=F.col("cols"), table=F.col("cat.name"), part=F.col("part_ord"))


def leftmost_prefix(b: DataFrame, o: Options) -> DataFrame:
    """SIA003. The first index of which a later column is used and one before it is not."""
    b = b.where(_known()).withColumn("used", columns_of(F.concat("equality", "in_list", "ranges", "ordering")))

    def read(i: Column) -> Column:
        stop = F.array_position(F.transform(i["columns"], lambda c: ~_has(F.col("used"), c)), True).cast("int")
        run = F.when(stop == 0, F.size(i["columns"])).otherwise(stop - 1)
        gap = F.array_max(F.transform(i["columns"], lambda c, k: F.when((k > run) & _has(F.col("used"), c), -k)))
        return F.struct(i["name"].alias("name"), i["columns"].alias("columns"), run.alias("run"), (-gap).alias("gap"))

    plain = F.filter(_indexes(), lambda i: T.plain_parts(i["columns"]) & (F.size(i["columns"]) >= 2))
    hits = F.filter(F.transform(plain, read), lambda x: (x["run"] > 0) & x["gap"].isNotNull())
    b = b.withColumn("hit", F.get(hits, F.lit(0))).where(F.col("hit").isNotNull())
    wanted = F.concat(F.slice("hit.columns", 1, F.col("hit.run")), F.slice("hit.columns", F.col("hit.gap") + 1, 1))
    skipped = F.slice("hit.columns", F.col("hit.run") + 1, F.col("hit.gap") - F.col("hit.run"))
    b = b.withColumn("wanted", wanted).withColumn("skipped", F.array_join(skipped, ", "))
    message = F.concat(_lit("Query uses "), F.col("hit.name"), _lit(" but skips "), F.col("skipped"), _lit("; only "), F.col("hit.run").cast("string"), _lit(" column(s) are usable as a range prefix."))
    return finding(b, "SIA003", "warn", message, F.array(T.add_index_ddl("cat.name", "wanted")), index_columns=F.col("wanted"), table=F.col("cat.name"))


def _rewrites() -> dict[str, Column]:
    """Sargable forms of the wrapped predicate in `w`, and whether it can never be true."""
    raw, value, op, bound = F.col("w.raw"), F.trim("w.value_text"), F.col("w.op"), F.col("w.parameterized")
    literal = T.string_literal(value)
    call = lambda name, more="": rf"(?i)^{name}\(\s*([\w.`]+)\s*{more}\)$"
    date = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    part = lambda i: F.nullif(F.regexp_extract(F.coalesce(literal, value), date, i), F.lit("")).cast("int")
    # months and days roll over as in a calendar
    day = F.date_add(F.add_months(F.try_make_timestamp(part(1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"), part(2) - 1), part(3) - 1)
    timed = F.coalesce(part(4), F.lit(0)) + F.coalesce(part(5), F.lit(0)) + F.coalesce(part(6), F.lit(0)) > 0
    column = F.regexp_extract(raw, r"(?i)^\w+\(\s*([\w.`]+)", 1)
    is_date, is_year, is_left = raw.rlike(call("DATE")), raw.rlike(call("YEAR")), raw.rlike(call("LEFT", r",\s*\d+\s*"))
    midnight = lambda d: F.concat(_lit("'"), F.date_format(d, "yyyy-MM-dd"), _lit(" 00:00:00'"))
    window = lambda low, high: F.concat(column, _lit(" >= "), low, _lit(" AND "), column, _lit(" < "), high)
    year = F.nullif(F.regexp_extract(value, r"^'?(\d{4})'?$", 1), F.lit("")).cast("int")
    day_form = F.when(day.isNotNull(), window(midnight(day), midnight(F.date_add(day, 1)))).when(bound, window(_lit("DATE(?)"), _lit("DATE(?) + INTERVAL 1 DAY")))
    year_edge = lambda y: F.concat(_lit("'"), y.cast("string"), _lit("-01-01 00:00:00'"))
    year_form = F.when(year > 0, window(year_edge(year), year_edge(year + 1))).when(bound, window(_lit("MAKEDATE(YEAR(?), 1)"), _lit("MAKEDATE(YEAR(?) + 1, 1)")))
    # a prefix of another length than the literal is another predicate
    width = F.regexp_extract(raw, r",\s*(\d+)", 1).try_cast("int")
    fits = F.length(F.replace(literal, F.lit("''"), F.lit("'"))) == width
    left_form = F.when(literal.isNotNull() & fits, F.concat(column, _lit(" LIKE '"), F.regexp_replace(literal, r"([%_])", r"\\$1"), _lit("%'"))).when(literal.isNull() & bound, F.concat(column, _lit(" LIKE CONCAT(?, '%')")))
    sum_ = r"^([\w.`]+)\s*([+-])\s*(\d+(?:\.\d+)?)$"
    sign, offset = F.regexp_extract(raw, sum_, 2), F.regexp_extract(raw, sum_, 3)
    number, k = T.numeric_literal(value).try_cast("decimal(30,10)"), F.nullif(offset, F.lit("")).try_cast("decimal(30,10)")
    moved = F.regexp_replace(F.regexp_replace(F.when(sign == "+", number - k).otherwise(number + k).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    other = F.when(value == "?", F.concat(_lit("? "), F.when(sign == "+", "-").otherwise("+"), _lit(" "), offset)).otherwise(moved)
    sum_form = F.when(other.isNotNull(), F.concat(F.regexp_extract(raw, sum_, 1), _lit(" "), op, _lit(" "), other))
    equal = op == "="
    return {
        "rewrite": F.when(is_date & equal, day_form).when(is_year & equal, year_form).when(is_left & equal, left_form).when(raw.rlike(sum_) & op.isin("=", ">", "<", ">=", "<=", "!=", "<>"), sum_form),
        "never": F.coalesce(is_date & equal & literal.isNotNull() & day.isNotNull() & timed, F.lit(False)),
    }


def wrapped_column(b: DataFrame, o: Options) -> DataFrame:
    """SIA004. Functions or arithmetic on a tested column, with the sargable form where one is provable; and patterns that begin with %."""
    text = lambda r: F.coalesce(r["predicate_text"], r["raw"])
    firsts = lambda refs: F.filter(refs, lambda r, k: ~F.exists(F.slice(refs, 1, k), lambda q: text(q) == text(r)))
    w = b.withColumn("w", F.explode(F.transform(firsts(F.col("wrapped")), lambda r, k: r.withField("i", k))))
    forms = _rewrites()
    w = settled(w.withColumn("form", forms["rewrite"]).withColumn("never", forms["never"]), "wrapped")  # the forms are used many times below
    qualifier = F.regexp_replace("w.raw", r"(?<![\w.])`?\w+`?\s*\.\s*(?=[\w`])", "")  # an index expression has no aliases
    w = w.withColumn("expression", qualifier).withColumn("cols", F.array("w.column"))
    name = T.index_name("cat.name", "cols")
    named = F.coalesce(F.exists(_indexes(), lambda i: F.lower(i["name"]) == F.lower(name)), F.lit(False)) & _known()
    w = w.withColumn("named", named)
    ddl = F.when(F.lit(o.mysql_version >= 8) & _known() & ~F.col("named") & ~F.col("never"), F.array(F.concat(_lit("ALTER TABLE "), T.quoted("cat.name"), _lit(" ADD INDEX "), T.quoted(name), _lit(" (("), F.col("expression"), _lit("));")))).otherwise(F.array().cast("array<string>"))
    severity = F.when(F.col("named"), "warn").when(F.col("never") | F.col("form").isNotNull(), "error").otherwise("warn")
    message = F.concat_ws(
        " ",
        F.when(F.col("never"), F.concat(_lit("Predicate "), text(F.col("w")), _lit(" can never be true: DATE() is midnight and the literal has a time of day. No index can help it.")))
        .otherwise(F.concat(_lit("Expression `"), F.col("w.raw"), _lit("` on "), F.col("table"), _lit("."), F.col("w.column"), _lit(" prevents index use: the index holds the raw value."))),
        F.when(~F.col("never") & F.col("form").isNotNull(), F.concat(_lit("Rewrite it as: "), F.col("form"), _lit("."))).when(~F.col("never"), _lit("No equivalent rewrite is provable for this shape.")),
        F.when(F.col("named"), F.concat(_lit("The table has an index named "), name, _lit(": confirm with SHOW INDEX whether it holds this expression."))),
        _lit("MySQL 8.0 can index the expression itself." if o.mysql_version >= 8 else "MySQL 5.7 has no functional index."),
    )
    out = finding(w, "SIA004", severity, message, ddl, F.when(~F.col("never"), F.col("form")), part=F.col("w.i"))
    middle = F.filter("ranges", lambda r: r["op"] == "like-middle")
    m = b.withColumn("w", F.explode(F.transform(firsts(middle), lambda r, k: r.withField("i", k + 1000))))
    said = F.concat(_lit("Predicate "), text(F.col("w")), _lit(" begins its pattern with %, which no B-tree index can seek. Use a pattern anchored at its beginning, a fulltext index, or require a prefix."))
    return out.unionByName(finding(m, "SIA004", "info", said, part=F.col("w.i")))


def implicit_conversion(b: DataFrame, o: Options) -> DataFrame:
    """SIA005. A string column compared with bare numbers: the column is converted row by row."""
    b = b.where(_known()).withColumn("w", F.explode(F.concat("equality", "in_list")))
    b = b.withColumn("c", _column_of(F.col("w.column"))).where(F.col("c.type").isin(*T.STRING_TYPES) & ~F.col("w.parameterized") & F.col("w.predicate_text").isNotNull())
    quote = lambda x: F.when(T.numeric_literal(x).isNotNull(), F.concat(_lit("'"), F.trim(x), _lit("'"))).otherwise(F.trim(x))
    items = F.split(F.regexp_extract("w.value_text", r"(?s)^\((.*)\)$", 1), ",")
    bare = F.regexp_replace("w.value_text", r"'(?:[^']|'')*'", "")  # a comma in a string would split it
    one = F.when((F.col("w.op") == "=") & T.numeric_literal("w.value_text").isNotNull(), F.concat(F.col("w.raw"), _lit(" = "), quote(F.col("w.value_text"))))
    many = F.when((F.col("w.op") == "in") & (F.size(items) == F.size(F.split(bare, ","))) & F.exists(items, lambda x: T.numeric_literal(x).isNotNull()), F.concat(F.col("w.raw"), _lit(" IN ("), F.array_join(F.transform(items, quote), ", "), _lit(")")))
    b = b.withColumn("form", F.coalesce(one, many)).where(F.col("form").isNotNull())
    whole = T.replaced_once(F.col("parsed.full_sql"), F.col("w.predicate_text"), F.col("form"))
    message = F.concat(F.col("cat.name"), _lit("."), F.col("c.name"), _lit(" is "), F.col("c.type"), _lit(" but "), F.col("w.predicate_text"), _lit(" compares it with a number, so MySQL converts the column and no index on it is used. Quote the literal: "), F.col("form"))
    return finding(b, "SIA005", "error", message, rewrite=whole, table=F.col("cat.name"), part=F.col("w.i"))


def deep_pagination(b: DataFrame, o: Options) -> DataFrame:
    """SIA006. A large literal OFFSET: the deferred join over the primary key, if the projection and the sort can be carried over."""
    limit = F.col("parsed.limit")
    b = b.where((F.col("parsed.kind") == "select") & limit["literal"] & (limit["offset"] >= o.deep_offset) & (F.size("parsed.tables") == 1))
    t = F.get("parsed.tables", F.lit(0))
    pk = F.coalesce(F.get(F.get(F.filter(_indexes(), lambda i: i["primary"]), F.lit(0))["columns"], F.lit(0)), _lit("id"))
    alias = F.coalesce(t["alias"], _lit(""))
    bare = lambda x: F.when(alias == "", x).otherwise(F.regexp_replace(x, F.concat(_lit(r"(?i)(?<![\w.])`?\Q"), alias, _lit(r"\E`?\s*\.\s*")), _lit("")))
    star, plain = F.col("parsed.select_star"), F.col("parsed.select_plain")
    of_t = lambda c: F.concat(_lit("t."), T.quoted(c))
    projection = F.when(star & (F.size("parsed.select_columns") == 0), _lit("t.*")).when(plain, F.array_join(F.transform("parsed.select_columns", of_t), ", "))
    output = lambda c: F.array_contains("parsed.select_aliases", c) & ~F.array_contains("parsed.select_columns", c)
    own = lambda r: r["table"].isNull() | (r["table"] == F.lower(alias)) | (r["table"] == F.lower(t["name"]))
    order_text = F.col("parsed.order_by_text")
    carried = F.forall("parsed.order_by", lambda r: ~r["wrapped"] & ~output(r["column"]) & own(r))
    sortable = order_text.isNull() | (F.size("parsed.order_by") == F.size(F.split(order_text, ","))) & carried
    outer_order = F.when(order_text.isNull(), _lit("")).otherwise(F.concat(_lit(" ORDER BY "), F.array_join(F.transform("parsed.order_by", lambda r: F.concat(of_t(r["column"]), F.when(r["desc"], " DESC").otherwise(""))), ", ")))
    faithful = projection.isNotNull() & sortable & ~F.col("parsed.select_distinct") & ~F.col("parsed.grouped")
    correlated = F.coalesce(F.col("parsed.where_text").rlike(r"(?i)\(\s*select\b"), F.lit(False)) & (alias != "")
    where = F.coalesce(F.concat(_lit(" WHERE "), bare(F.col("parsed.where_text"))), _lit(""))
    order = F.coalesce(F.concat(_lit(" ORDER BY "), bare(order_text)), _lit(""))
    count = F.coalesce(limit["row_count"], F.lit(20)).cast("string")
    join = F.concat(
        _lit("SELECT "), projection, _lit(" FROM (SELECT "), T.quoted(pk), _lit(" FROM "), T.quoted(t["name"]), where, order, _lit(" LIMIT "), limit["offset"].cast("string"), _lit(", "), count,
        _lit(") AS page JOIN "), T.quoted(t["name"]), _lit(" t ON "), of_t(pk), _lit(" = page."), T.quoted(pk), outer_order, _lit(";"),
    )
    key = F.get("parsed.order_by", F.lit(0))
    way = F.when(key["desc"], "<").otherwise(">")
    more = F.coalesce(F.concat(_lit("("), bare(F.col("parsed.where_text")), _lit(") AND ")), _lit(""))
    seek = F.when(key.isNotNull() & faithful & (F.size("parsed.order_by") == 1), F.concat(_lit("SELECT "), projection, _lit(" FROM "), T.quoted(t["name"]), _lit(" t WHERE "), more, _lit("("), of_t(key["column"]), _lit(" "), way, _lit(" ? OR ("), of_t(key["column"]), _lit(" = ? AND "), of_t(pk), _lit(" "), way, _lit(" ?))"), outer_order, _lit(" LIMIT "), count, _lit(";")))
    b = b.withColumn("faithful", faithful).withColumn("correlated", correlated)
    message = F.concat_ws(
        " ",
        F.concat(_lit("OFFSET "), limit["offset"].cast("string"), _lit(" scans and discards rows before returning "), count, _lit("; use a deferred join or keyset pagination.")),
        F.when(F.col("correlated"), "The WHERE clause has a subquery, so no rewrite is given.").when(~F.col("faithful"), "The projection, grouping or sort cannot be carried over column by column, so no rewrite is given."),
        F.when(seek.isNotNull(), F.concat(_lit("Keyset form: "), seek)).when(key.isNull(), _lit("Keyset pagination needs a stable sort key, and this query has no ORDER BY.")),
        F.when(~_known(), "The catalog does not have this table, so the primary key is assumed to be id."),
    )
    return finding(b, "SIA006", F.when(F.col("correlated"), "info").otherwise("warn"), message, rewrite=F.when(F.col("faithful") & ~F.col("correlated"), join), table=t["name"])


def covering_index(b: DataFrame, o: Options) -> DataFrame:
    """SIA007. An index that finds the rows of a costly query but lacks columns it reads."""
    b = b.where((F.col("rows_examined") >= ROW_PRESSURE) & (F.col("parsed.kind") == "select") & ~F.col("parsed.select_star") & (F.size("parsed.select_columns") > 0) & (F.size("parsed.tables") == 1) & _known())
    b = b.withColumn("wheres", columns_of(F.concat("equality", "in_list", "ranges"))).where(F.size("wheres") > 0)
    n = F.size("wheres")
    serves = lambda i: T.plain_parts(i["columns"]) & (F.size(i["columns"]) >= n) & (F.array_sort(F.slice(i["columns"], 1, n)) == F.array_sort("wheres"))
    b = b.withColumn("base", F.get(F.filter(_indexes(), serves), F.lit(0))).where(F.col("base").isNotNull())
    added = F.array_except(F.array_distinct(F.concat(columns_of(F.col("ordering")), F.array_distinct("parsed.select_columns"))), F.col("base.columns"))
    b = b.withColumn("added", added).withColumn("wide", F.concat("base.columns", "added")).where((F.size("added") > 0) & (F.size("wide") <= MAX_COVERING_COLUMNS))
    sizes = F.transform("wide", lambda c: _size_of(_column_of(c)))
    b = b.withColumn("bytes", F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x))
    b = b.where(F.forall("wide", lambda c: _column_of(c).isNotNull()) & (F.col("bytes") <= o.prefix_bytes))
    message = F.concat(_lit("Extending "), F.col("base.name"), _lit(" to cover ("), F.array_join("wide", ", "), _lit(") spares reading the row for "), F.col("rows_examined").cast("string"), _lit(" examined rows."))
    return finding(b, "SIA007", F.when(F.col("rows_examined") >= HIGH_ROW_PRESSURE, "error").otherwise("warn"), message, F.array(T.add_index_ddl("cat.name", "wide")), index_columns=F.col("wide"), table=F.col("cat.name"))


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    needs_schema: bool
    needs_metrics: bool
    run: Callable[[DataFrame, Options], DataFrame]


RULES = (
    Rule("SIA001", "Missing index candidate", False, False, missing_index),
    Rule("SIA002", "Prefix index", True, False, prefix_index),
    Rule("SIA003", "Leftmost-prefix violation", True, False, leftmost_prefix),
    Rule("SIA004", "Function or expression on an indexed column", False, False, wrapped_column),
    Rule("SIA005", "Implicit type conversion invalidates the index", True, False, implicit_conversion),
    Rule("SIA006", "Deep pagination", False, False, deep_pagination),
    Rule("SIA007", "Covering index opportunity", True, True, covering_index),
)


def chosen(options: Options) -> list[Rule]:
    names = None if options.rules is None else {r.upper() for r in options.rules}
    return [r for r in RULES if names is None or r.id in names]


def severity_rank(severity: Column | str) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    return F.when(severity == "error", 2).when(severity == "warn", 1).otherwise(0)


def run_rules(b: DataFrame, options: Options, has_schema: bool, custom: tuple[Rule, ...] = (), errors: list[tuple[str, str]] | None = None) -> DataFrame:
    """Findings of all chosen rules that have what they need, from min_severity up.

    With a list for errors, a rule that fails is named there and the others go on. A custom rule's rows are computed to know; the seven fail with the plan or not at all.
    """
    b = settled(b, "buckets")  # every rule reads it, and it is as small as the catalog and the distinct patterns are
    found = [finding(b.limit(0), "", "", F.lit(""))]
    for rule in (*chosen(options), *custom):
        if rule.needs_schema and not has_schema:
            continue
        try:
            made = rule.run(b, options).select(*found[0].columns)
            if rule in custom and errors is not None:
                made = settled(made, "custom")
                made.count()
            found.append(made)
        except Exception as error:
            if errors is None:
                raise
            errors.append((rule.id, f"{type(error).__name__}: {str(error).splitlines()[0][:300] if str(error) else ''}"))
    return reduce(DataFrame.unionByName, found).where(severity_rank("severity") >= SEVERITIES[options.min_severity])
