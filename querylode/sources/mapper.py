"""MyBatis mapper XML as records: each statement in the variants that its dynamic tags allow."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.functions.text import fingerprint
from querylode.sources.sql_text import as_records

#: The most variants of one statement.
MAX_VARIANTS = 10
KINDS = ("select", "insert", "update", "delete")
STATEMENT = pa.struct([("namespace", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("parameter_type", pa.string()), ("database_id", pa.string()), ("raw_interpolation", pa.bool_()), ("notes", pa.list_(pa.string())), ("variants", pa.list_(pa.struct([("sql", pa.string()), ("label", pa.string())])))])
STATEMENT_DDL = "struct<namespace:string,id:string,kind:string,line:int,parameter_type:string,database_id:string,raw_interpolation:boolean,notes:array<string>,variants:array<struct<sql:string,label:string>>>"

_TAG = re.compile(r"<(/?)([\w:-]+)((?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>|<!\[CDATA\[(.*?)\]\]>", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


class Node:
    """An element: its name, attributes, and children that are nodes or text."""

    def __init__(self, name: str, attributes: dict[str, str], line: int):
        self.name, self.attributes, self.line = name, attributes, line
        self.children: list[Node | str] = []

    def find(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name in names]


def tree(text: str) -> Node:
    """A forgiving reader: comments keep their lines, unknown or unclosed tags don't stop it."""
    text = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    root = Node("", {}, 1)
    open_nodes, at = [root], 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            open_nodes[-1].children.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if m[5] is not None:
            open_nodes[-1].children.append(m[5])
        elif m[1]:
            if any(n.name == m[2] for n in open_nodes[1:]):
                while open_nodes.pop().name != m[2]:
                    pass
        else:
            node = Node(m[2], {k: html.unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m[3])}, text.count("\n", 0, m.start()) + 1)
            open_nodes[-1].children.append(node)
            if not m[4]:
                open_nodes.append(node)
    open_nodes[-1].children.append(html.unescape(text[at:]))
    return root


class Expansion:
    """A statement's variants: each choice of each <choose>, all conditions taken, fragments included."""

    def __init__(self, fragments: dict[str, Node]):
        self.fragments, self.notes = fragments, []

    def of(self, children: list[Node | str], depth: int = 0) -> list[tuple[str, str]]:
        """(text, label) of each variant."""
        out = [("", "")]
        for child in children:
            steps = [(child, "")] if isinstance(child, str) else self.node(child, depth)
            out = [(text + step, ">".join(x for x in (label, more) if x)) for text, label in out for step, more in steps]
            if len(out) > MAX_VARIANTS:
                self.notes.append(f"more than {MAX_VARIANTS} variants: the first are analysed")
                out = out[:MAX_VARIANTS]
        return out

    def node(self, node: Node, depth: int) -> list[tuple[str, str]]:
        name = node.name
        if name in ("selectKey", "bind"):
            return [("", "")]
        if name == "include":
            fragment = self.fragments.get(node.attributes.get("refid", "").rsplit(".", 1)[-1])
            if fragment is None or depth > 20:
                self.notes.append(f"fragment {node.attributes.get('refid')} is not in this file")
                return [(" ", "")]
            return self.of(fragment.children, depth + 1)
        if name == "choose":
            ways = [(f"when[{i}]", n) for i, n in enumerate(node.find("when"))] + [("otherwise", n) for n in node.find("otherwise")]
            return [(text, ">".join(x for x in (label, more) if x)) for label, n in ways for text, more in self.of(n.children, depth)] or [("", "")]
        inner = self.of(node.children, depth)
        if name == "foreach":
            a = node.attributes
            return [(f" {a.get('open', '')} ? {a.get('close', '')} ", label) for _, label in inner]
        if name in ("where", "set", "trim"):
            a = node.attributes
            prefix, drop, suffix, cut = {"where": ("WHERE", r"AND\b|OR\b", "", ""), "set": ("SET", "", "", ",")}.get(name) or (a.get("prefix", ""), self._any(a.get("prefixOverrides")), a.get("suffix", ""), self._any(a.get("suffixOverrides")))
            out = []
            for text, label in inner:
                body = text.strip()
                if drop:
                    body = re.sub(rf"^(?:{drop})\s*", "", body, flags=re.I)
                if cut:
                    body = re.sub(rf"\s*(?:{cut})$", "", body, flags=re.I)
                out.append((f" {prefix} {body} {suffix} " if body else " ", label))
            return out
        if name not in ("if", "when", "otherwise", "sql", "values"):
            self.notes.append(f"tag <{name}> is left out, its content kept")
        return [(f" {text} ", label) for text, label in inner]

    @staticmethod
    def _any(overrides: str | None) -> str:
        return "|".join(re.escape(x.strip()) + (r"\b" if x.strip().isalpha() else "") for x in (overrides or "").split("|") if x.strip())


def mapper_statements(text: str | None) -> list[dict]:
    """Statements of a mapper file; none if it isn't one."""
    mappers = [n for n in tree(text or "").find("mapper")]
    out = []
    for mapper in mappers:
        fragments = {n.attributes.get("id", ""): n for n in mapper.find("sql")}
        for node in sorted(mapper.find(*KINDS), key=lambda n: KINDS.index(n.name)):
            expansion = Expansion(fragments)
            variants, raw = [], False
            for sql, label in expansion.of(node.children):
                raw = raw or "${" in sql
                sql = re.sub(r"(?<=\w)\$\{[^}]*\}", "_", sql)  # a table's open suffix stays visible
                sql = re.sub(r"#\{[^}]*\}|\$\{[^}]*\}", "?", sql)
                variants.append({"sql": " ".join(sql.split()), "label": label})
            a = node.attributes
            notes = list(dict.fromkeys(expansion.notes + (["a part of the statement is built at run time (${})"] if raw else [])))
            out.append({"namespace": mapper.attributes.get("namespace"), "id": a.get("id"), "kind": node.name, "line": node.line, "parameter_type": a.get("parameterType"), "database_id": a.get("databaseId"), "raw_interpolation": raw, "notes": notes, "variants": variants})
    return out


def _read(texts: pa.Array) -> pa.Array:
    return pa.array([mapper_statements(t) for t in texts.to_pylist()], pa.list_(STATEMENT))


def statements_from_texts(texts: DataFrame) -> DataFrame:
    """Columns file, value: a row for each statement, in the order of the files' statements."""
    read = F.arrow_udf(_read, f"array<{STATEMENT_DDL}>")
    return texts.select("file", F.posexplode(read("value")).alias("pos", "s")).select("file", "pos", "s.*")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """XML files below a folder whose beginning names a mapper; build and dependency folders are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(path)
    files = files.where(~F.col("path").rlike(r"/(node_modules|\.git|target)/"))
    return files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("value")).where(F.substring("value", 1, 4096).contains("<mapper"))


def mapper_records(statements: DataFrame) -> DataFrame:
    """A record for each variant: statement_id is the statement's id, and the variant's label."""
    spread = statements.select("*", F.posexplode("variants").alias("variant", "v"))
    return as_records(
        spread.select(
            "file", "line", "namespace", "notes", "raw_interpolation", F.col("v.sql").alias("sql"), fingerprint("v.sql").alias("fingerprint"), F.lit(1).alias("occurrences"),
            F.concat("id", F.when(F.col("v.label") != "", F.concat(F.lit("#"), F.col("v.label"))).otherwise("")).alias("statement_id"), (F.col("pos") * (10 * MAX_VARIANTS) + F.col("variant")).alias("record_ord"),
        )
    )


def read_mappers(spark: SparkSession, path: str) -> DataFrame:
    return mapper_records(statements_from_texts(discover(spark, path)))
