import public_tokenizers
from tokenizers import Tokenizer

from querylode.llm.common import scratch
from querylode.llm.token_counts import Ledger, op5_token_counts, signed, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_signed_batches(spark):
    rows = [(1, "one two three", "a", "en"), (2, None, "a", None), (3, "", None, "en"), (4, "four five", "a", "en"), (4, "four five", "a", "en"), (5, "x " * 50000, "b", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    counts = token_counts(docs, {"v1": BYTE})
    ledger = Ledger(spark, scratch(spark, "ledger"))
    assert ledger.totals().collect() == []
    assert ledger.commit("all", signed(counts, "v1", 1))
    assert not ledger.commit("all", signed(counts, "v1", 1))
    ledger.commit("gone", signed(counts.where("doc_id = 4"), "v1", -1))
    ledger.commit("none", signed(counts.where("doc_id = 99"), "v1", -1))
    plain = Tokenizer.from_file(BYTE)
    want = {}
    for doc_id, text, source, lang in rows:
        n = want.setdefault((source, lang, "v1"), [0, 0])
        if doc_id != 4:
            n[0] += 1
            n[1] += len(plain.encode(text or "").ids)
    read = lambda: {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in ledger.totals().collect()}
    assert read() == want
    assert ledger.compact() in ledger.live() and len(ledger.live()) == 1
    assert read() == want


def deltas(spark, *rows):
    return spark.createDataFrame([("a", "en", "v1", *r) for r in rows], "source string, lang string, version string, n_docs long, n_tokens long")


def read(ledger):
    return [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()]


def test_folds_at_the_same_time_count_once(spark):
    folder = scratch(spark, "ledger")
    one, other = Ledger(spark, folder), Ledger(spark, folder)
    one.commit("x", deltas(spark, (1, 10)))
    one.commit("y", deltas(spark, (1, 10)))
    live, commit = other.live(), one.commit
    one.commit = lambda *a: (other.compact(), commit(*a))[1]  # the other folds after this one has chosen its batches
    assert one.compact() and read(other) == [(2, 20)]
    other.live = lambda: live  # and one that read the batches before they were folded
    assert other.compact() is None and read(one) == [(2, 20)]


def test_lost_folds_and_writers_change_nothing(spark):
    ledger = Ledger(spark, scratch(spark, "ledger"))
    ledger.commit("x", deltas(spark, (1, 10)))
    ledger.commit("y", deltas(spark, (1, 10)))
    put = ledger._put
    ledger._put = lambda content, *parts: parts[0] == "committed" and 1 / 0 or put(content, *parts)
    for lost in (lambda: ledger.commit("z", deltas(spark, (1, 10))), ledger.compact):
        try:
            lost()
        except ZeroDivisionError:
            pass
        assert read(ledger) == [(2, 20)]
    ledger._put = put
    assert ledger.commit("z", deltas(spark, (1, 10))) and read(ledger) == [(3, 30)]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "old", 7)], "doc_id long, text string, n_v1 string, _text long")
    got = token_counts(docs, {"v1": BYTE}).collect()[0]
    assert (got.doc_id, got["_text"], got.n_v1) == (1, 7, 2)


def plain_totals(rows):
    """Both vocabularies' totals of documents, one of each text (all rows of its smallest doc_id), without repeated lines."""
    out = {}
    least = {}
    for doc_id, text, _, _ in rows:
        least[text or ""] = min(least.get(text or "", 1 << 63), 1 << 63 if doc_id is None else doc_id)
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        coder = Tokenizer.from_file(public_tokenizers.path(f"{version}.json"))
        for doc_id, text, source, lang in rows:
            total = out.setdefault((source, lang, version), [0, 0])
            if least[text or ""] == (1 << 63 if doc_id is None else doc_id):
                total[0] += 1
                total[1] += len(coder.encode("\n".join(dict.fromkeys((text or "").split("\n"))), add_special_tokens=False).ids)
    return out


def test_query_equals_a_plain_count(spark, tmp_path):
    rows = [(1, "a b\na b\nc", "s", "en"), (2, "a b\na b\nc", "s", "en"), (3, "solo", "s", "en"), (4, None, "t", "en"), (5, "", "t", None), (5, "a b\na b\nd", None, "en"), (5, "solo text here", "t", "en"), (6, "x", "t", "en")]
    rows += [(7, "twice\ntwice", "t", "de"), (7, "twice\ntwice", "t", "de"), (8, "twice\ntwice", "s", "de"), (None, "solo", "s", "en"), (None, "no id\nno id", "s", "en"), (None, "no id\nno id", "s", "en"), (9, "word " * 30000, "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in op5_token_counts(spark, str(tmp_path)).collect()}
    assert got == plain_totals(rows)


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_token_counts(spark, str(tmp_path)).collect() == []
