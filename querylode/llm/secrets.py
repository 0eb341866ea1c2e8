"""Secret scans: fixed patterns, and the novelty of strings in sensitive places by dictionary-primed zstandard.

Base spans are the leftmost non-overlapping matches of each pattern in the whole text, kept if long enough. Beyond
them, every string that begins near a sensitive word (key, auth, credential ...) is a candidate, as far as it runs. The compressor
is primed with a dictionary of common code identifiers, the text around without the candidate's copies, and what comes before in
the candidate; its marginal bytes are what each window of it adds. A window is so short that zstandard leaves its literals raw, so
the alphabet and the length of a key don't count. A known name or path adds little; a key adds nearly its own length, and is
reported as "novel", unless its letters follow each other as those of words do. A candidate that isn't is tried in the
parts between the sensitive words in it.

Spans are code points of the text, the end exclusive. Defined results: a null or empty text has no spans; repeated
rows are scanned alike; long texts are scanned whole; extra columns are left out (redact() keeps them); an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm.common import CONTINUATION, doc_rows, doc_text, small_batches, table

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
MIN_VALUE, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows sensitive.
SENSITIVE = re.compile(rb"passphrase|private[_-]?key|access[_-]?key|signing[_-]?key|api[_-]?key|client[_-]?secret|secret|token|credential|bearer|authorization|auth|passw|pwd", re.I)
_HINTS = (b"pass", b"key", b"secret", b"token", b"cred", b"bearer", b"auth", b"pwd")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~!@#$%^&*.-]{16,}")
#: Bytes after a sensitive word within which a candidate begins, and of the surroundings on either side.
REACH, AROUND = 48, 512
MIN_CANDIDATE = 16
#: zstandard codes 63 literals and more by their frequency.
WINDOW = 48
#: Least marginal bytes for each byte of a candidate.
NOVELTY = 0.85

#: The identifier dictionary that primes the compressor.
IDENTIFIERS = (
    b"password username secret token api_key apiKey access_token refresh_token client_id client_secret authorization bearer credentials private_key public_key signature "
    b"session cookie request response header headers content_type application/json localhost example.com http:// https:// www. import from return function const let var "
    b"class public private protected static void string String int integer boolean true false null None self this def async await export default require module config "
    b"configuration environment variable process.env os.environ getenv settings database connection username hostname port timeout retry handler callback listener service "
    b"controller repository factory builder manager provider context instance parameter argument exception error message status code value index length count offset limit "
    b"SELECT FROM WHERE INSERT UPDATE DELETE CREATE TABLE PRIMARY KEY abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx ****************"
)


#: Words whose letters show how those of names follow each other.
WORDS = (
    b"the of and that with this from they have which their would there about other were what your when more these some time could people than first been into only over new "
    b"between through government international development information administration characteristics responsibility representation understanding communication organization "
    b"relationship environmental approximately particularly traditional performance university knowledge individual experience independent significant professional "
    b"management technology production successful opportunity established throughout neighborhood straightforward nevertheless strength thought language question "
    b"company president history family business science children water school health policy market political economic physical medical analysis example problem system "
    b"subject program support beautiful different important possible available everything something because however although together especially industry employee"
)
KINDS_OF = bytes(1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 0 for c in range(256))
#: How often a small letter, a capital or a digit (1, 2, 3) comes after one in names.
TURNS = {(1, 1): 0.88, (1, 2): 0.08, (1, 3): 0.04, (2, 1): 0.4, (2, 2): 0.55, (2, 3): 0.05, (3, 1): 0.075, (3, 2): 0.075, (3, 3): 0.85}


def _pairs() -> dict[tuple[int, int], float]:
    """Bits of each pair of letters or digits in names: the second, given the first."""
    seen: dict[tuple[int, int], float] = {}
    for word in re.findall(rb"[a-z]+", (IDENTIFIERS.replace(b"abcdefghijklmnopqrstuvwxyz", b"") + b" " + WORDS).lower()):
        for pair in zip(word, word[1:], strict=False):
            seen[pair] = seen.get(pair, 0.0) + 1
    after = {x: sum(seen.get((x, y), 0.0) for y in range(97, 123)) for x in range(97, 123)}
    bits = {}
    for x in range(256):
        for y in range(256):
            kinds = KINDS_OF[x], KINDS_OF[y]
            if kinds in TURNS:
                low = x | 32, y | 32
                given = 0.1 if kinds[1] == 3 else 1 / 26 if kinds == (1, 2) or kinds[0] == 3 else (seen.get(low, 0.0) + 0.3) / (after[low[0]] + 7.8)
                bits[x, y] = -math.log2(TURNS[kinds] * given)
    return bits


PAIRS = _pairs()


_HEX_ONLY = re.compile(rb"[^A-Za-z]*(?:[a-f][^A-Zg-z]*|[A-F][^G-Za-z]*)?")


def wordlike(candidate: bytes) -> bool:
    """Whether its letters and digits take fewer bits as a name than as random ones of its alphabet."""
    bits = [PAIRS[p] for p in zip(candidate, candidate[1:], strict=False) if p in PAIRS]
    kinds = set(candidate.translate(KINDS_OF))
    alphabet = 16 if _HEX_ONLY.fullmatch(candidate) else 26 * (1 in kinds) + 26 * (2 in kinds) + 10 * (3 in kinds)
    return bool(bits) and sum(bits) < len(bits) * math.log2(alphabet)


class Novelty:
    def __init__(self, level: int = 9):
        self.level = level

    def ratio(self, text: bytes, start: int, end: int) -> float:
        """Marginal compressed bytes of text[start:end] for each of its bytes, given the surroundings without it."""
        candidate = text[start:end]
        around = (text[max(0, start - AROUND) : start] + b" " + text[end : end + AROUND]).replace(candidate, b" ")
        added = 0
        for at in range(0, len(candidate), WINDOW):
            primer = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around + b"\n" + candidate[max(0, at - AROUND) : at], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=self.level, dict_data=primer, write_content_size=False, write_dict_id=False)
            added += len(packer.compress(b" " + candidate[at : at + WINDOW])) - len(packer.compress(b" "))
        return added / len(candidate)


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the taken spans (in order, apart) leave of a candidate, if long enough."""
    for a, b in taken[bisect.bisect_left(taken, start, key=lambda t: t[1]) :]:
        if a >= end:
            break
        if a - start >= MIN_CANDIDATE:
            yield start, a
        start = max(start, b)
    if end - start >= MIN_CANDIDATE:
        yield start, end


def candidates(text: bytes) -> Iterator[tuple[int, int]]:
    """Every run that begins after a sensitive word and within its reach, to its end, once."""
    reached = 0
    for word in SENSITIVE.finditer(text):
        at, last = max(word.end(), reached), word.end() + REACH
        while at <= last and (m := CANDIDATE.search(text, at, last + MIN_CANDIDATE)):
            at = reached = CANDIDATE.match(text, m.start()).end()
            yield m.start(), at


def spans(text: bytes, novelty: Novelty, least: float = NOVELTY) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes."""
    found: list[tuple[str, int, int]] = []
    lower = text.lower()
    hinted = any(h in lower for h in _HINTS) or b"api" in lower
    if hinted:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if hinted:
        taken: list[tuple[int, int]] = []
        for _, a, b in sorted(found, key=lambda s: s[1]):
            if taken and a <= taken[-1][1]:
                taken[-1] = taken[-1][0], max(b, taken[-1][1])
            else:
                taken.append((a, b))

        def novel(a: int, b: int) -> bool:
            return not wordlike(text[a:b]) and novelty.ratio(text, a, b) >= least

        for run in candidates(text):
            for a, b in outside(*run, taken):
                if novel(a, b):
                    found.append(("novel", a, b))
                    continue
                cuts = [a, *(w.end() for w in SENSITIVE.finditer(text, a, b)), b]
                if len(cuts) > 2:
                    found += [("novel", x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= MIN_CANDIDATE and novel(x, y)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def in_code_points(text: bytes, found: list[tuple[str, int, int]]) -> list[dict]:
    at = points = 0
    places: dict[int, int] = {}
    for place in sorted({p for _, a, b in found for p in (a, b)}):
        points += len(text[at:place].translate(None, CONTINUATION))
        at = place
        places[place] = points
    return [{"kind": k, "start": places[a], "end": places[b]} for k, a, b in found]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(documents: DataFrame, least: float = NOVELTY) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row; one pass, no shuffle."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            found = [in_code_points(text, hits) if (hits := spans(text, novelty, least)) else [] for _, text in doc_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, SPANS)], ["doc_id", "spans"])

    return doc_text(documents).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: bytes, found: list[tuple[str, int, int]], mark: bytes) -> bytes:
    out, at, reach = [], 0, 0
    for _, a, b in found:
        if a >= reach:
            out += [text[at:a], mark]
        reach = max(reach, b)
        at = reach
    return b"".join([*out, text[at:]])


def redact(documents: DataFrame, mark: str = "[secret]", least: float = NOVELTY) -> DataFrame:
    """The rows of documents with each run of overlapping spans in text replaced by the mark, and n_chars, if there, made to fit. Rows without spans stay as they are."""
    small_batches(documents.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        novelty = Novelty()
        out = []
        for text in texts.cast(pa.binary()).to_pylist():
            hits = spans(text, novelty, least) if text else []
            out.append(redacted(text, hits, mark.encode()) if hits else text)
        return pa.array(out, pa.binary()).cast(pa.string())

    done = documents.withColumn("text", clean(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast(kind)))
    return done


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of("novel").alias("n_novel")
    )
