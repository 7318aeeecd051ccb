"""Secret scans by dictionary-primed zstandard novelty.

Three fixed patterns give the base spans (assign, access, hex), which always stay. Beside them, a run
of the characters that keys are made of is a candidate if it stands in a sensitive context: in one of
the ``REACH`` words after a sensitive name, or beginning as a known issuer's keys do. Each candidate's novelty is
measured by compression: zstandard, primed with a dictionary of the corpus' identifiers, compresses
the text around the candidate without and with it; the difference, its marginal bytes, is small for
names, words and paths, which the dictionary or the surroundings explain, and near the run's own length for
a random string. Candidates that stay incompressible are reported as spans of kind ``novel``.

The dictionary is learnt from all texts: identifiers of ``WORD`` or more characters, by the number of
different words that precede them (a 64-bit sketch, merged by "or"), so that a secret that is copied
with its surroundings, however often, is no known identifier. Tasks send their sums; the most varied identifiers
are taken up to ``DICTIONARY`` bytes, which is all that reaches the driver. Texts are read once;
what is found there is stored, and scoring reads that table.

Defined cases: a null text is empty; texts are read whole; spans are in code points, end exclusive, by
start, then kind; every row is judged, also repeated ones; null ids are kept; a candidate that overlaps a base
span is none; without identifiers the dictionary is empty; an empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm.bpe import slices
from encore.llm.common import map_texts, stored, table

KINDS = ["assign", "access", "hex", "novel"]
REACH = 3  # words after the one with a sensitive name
LEAST = 12  # characters of a candidate
WORD = 8  # characters of an identifier of the dictionary
CONTEXTS = 8  # different words before it, as the sketch counts them
DICTIONARY = 32_768  # bytes
IDENTIFIERS = DICTIONARY // WORD
AROUND = 256  # code points on either side that a candidate is compressed with
MARGINAL = 10  # bytes that a secret adds at least
NOVELTY = 0.8  # bytes that each of its characters adds at least
LEVEL = 19
TASK_WORDS = 200_000  # identifiers that a task counts before it sends them on

# --- base patterns: fixed by the contract --------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run of these characters fails as a whole
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# --- sensitive contexts: fixed lists ---------------------------------------------------------------

SENSITIVE = re.compile(
    r"(?:passphrase|password|passwd|passcode|pwd|secret|token|credential|bearer|authorization|auth|signature|jwt"
    r"|session[_-]?id|(?:api|access|private|signing|encryption|client|session|master|account|storage|ssh)[\x20_-]?key)s?(?![A-Za-z])",
    re.IGNORECASE | re.ASCII,
)
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "signature", "jwt", "key", "session")
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|npm_|SG\.|eyJ)[A-Za-z0-9+/_.-]+")
RUN = re.compile(r"[A-Za-z0-9+/_.-]+={0,2}")
OPENING = re.compile(r"[:=\"'`(\[{<>,]")
SPACE = re.compile(r"\s")
IDENTIFIER = re.compile(r"[A-Za-z0-9_]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order."""
    low = text.lower()
    out = []
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _words(text: str, at: int, n: int) -> Iterator[tuple[int, int]]:
    """The next ``n`` words from ``at``, which is not inside a word."""
    while n and at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = SPACE.search(text, at)
        end = m.start() if m else len(text)
        yield at, end
        at, n = end, n - 1


def _mixed(value: str) -> bool:
    """Characters of several sorts, as in keys: digits, small letters, capitals that begin no word."""
    digit = any("0" <= c <= "9" for c in value)
    small = any("a" <= c <= "z" for c in value)
    capital = re.search(r"[A-Za-z0-9][A-Z]", value) is not None
    return digit and (small or capital) or small and capital


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``(start, end)`` of the runs in sensitive contexts that no base span overlaps, in order."""
    low, found = text.lower(), set()
    if any(p in low for p in SENSITIVE_PARTS):
        m = SENSITIVE.search(text)
        while m:
            space = SPACE.search(text, m.end())
            own = space.start() if space else len(text)
            opening = OPENING.search(text, m.end(), own)
            parts = [(opening.end(), own)] if opening else []
            for a, b in [*parts, *_words(text, own, REACH)]:
                found.update(r.span() for r in RUN.finditer(text, a, b) if r.end() - r.start() >= LEAST)
            m = SENSITIVE.search(text, own)  # names of one word have the same words after them
    found.update(m.span() for m in ISSUED.finditer(text) if m.end() - m.start() >= LEAST)
    out, i, done = [], 0, 0
    spans = sorted((a, b) for a, _, b in base)
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while a < b and text[a] in "./_-+":
            a += 1
        while a < b and text[b - 1] in "./_-":
            b -= 1
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        free = i == len(spans) or spans[i][0] >= b
        if free and a >= done and b - a >= LEAST and _mixed(text[a:b]):
            out.append((a, b))
            done = b
    return out


def surroundings(text: str, start: int, end: int) -> str:
    """The text on both sides of a run, without other copies of it."""
    value = text[start:end]
    return f"{text[max(0, start - AROUND) : start]}\n{text[end : end + AROUND]}\n".replace(value, "")


# --- novelty -------------------------------------------------------------------------------------


class Novelty:
    """Marginal compressed bytes by a compressor that knows ``dictionary``."""

    def __init__(self, dictionary: bytes):
        known = None
        if dictionary:
            known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)

    def marginal(self, value: str, around: str) -> int:
        context = around.encode()
        return len(self.zstd.compress(context + value.encode())) - len(self.zstd.compress(context))

    def secret(self, value: str, around: str) -> bool:
        added = self.marginal(value, around)
        return added >= MARGINAL and added >= NOVELTY * len(value)


def dictionary_of(found: DataFrame) -> bytes:
    """The dictionary of the identifiers counted in ``scanned`` rows: the most varied ones last, where
    zstandard finds them cheapest."""
    words = found.where("word IS NOT NULL").groupBy("word").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    words = words.withColumn("contexts", F.bit_count("mask")).where(F.col("contexts") >= CONTEXTS)
    top = words.orderBy(F.desc("contexts"), F.desc("n"), "word").limit(IDENTIFIERS).select("word").collect()
    size, out = 0, []
    for r in top:
        size += len(r["word"]) + 1
        if size > DICTIONARY:
            break
        out.append(r["word"])
    return " ".join(reversed(out)).encode()


# --- Spark -------------------------------------------------------------------------------------

SPAN = "struct<start:int,kind:int,end:int>"
CANDIDATE = "struct<start:int,end:int,value:string,around:string>"


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts. A row per document: ``doc_id, base, found``, and rows ``word, mask, n``
    with a task's identifiers: a bit for each sort of word before it, and how often it occurs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[str, int] = {}
        times: dict[str, int] = {}
        id_type = None

        def counted() -> pa.RecordBatch:
            n = len(masks)
            mask = [m - (1 << 64) if m >> 63 else m for m in masks.values()]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.list_(span)), pa.nulls(n, pa.list_(candidate)), pa.array(list(masks), pa.string()), pa.array(mask, pa.int64()), pa.array(list(times.values()), pa.int64())],
                names,
            )

        for whole in batches:
            id_type = whole.schema.field(0).type
            for b in slices(whole):
                bases, found = [], []
                for text in b.column(1).to_pylist():
                    base = base_spans(text)
                    bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                    found.append([{"start": s, "end": e, "value": text[s:e], "around": surroundings(text, s, e)} for s, e in candidates(text, base)])
                    words = IDENTIFIER.findall(text)
                    for before, word in zip(["", *words], words):
                        if len(word) >= WORD:
                            masks[word] = masks.get(word, 0) | 1 << (zlib.crc32(before.encode()) & 63)
                            times[word] = times.get(word, 0) + 1
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(bases, pa.list_(span)), pa.array(found, pa.list_(candidate)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    names,
                )
                if len(masks) > TASK_WORDS:
                    yield counted()
                    masks.clear()
                    times.clear()
        if masks:
            yield counted()

    names = ["doc_id", "base", "found", "word", "mask", "n"]
    return map_texts(rows, run, f"doc_id {kind}, base array<{SPAN}>, found array<{CANDIDATE}>, word string, mask long, n long")


def judged(rows: DataFrame, dictionary: bytes) -> DataFrame:
    """``doc_id, base, spans``: the candidates of ``scanned`` rows that are novel join the base spans."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for b in batches:
            new = [[{"start": c["start"], "kind": 3, "end": c["end"]} for c in found if novelty.secret(c["value"], c["around"])] for found in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("base"), pa.array(new, span)], ["doc_id", "base", "new"])

    rows = map_texts(rows, run, f"doc_id {kind}, base array<{SPAN}>, new array<{SPAN}>")
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "new")).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, spans``, arrays of ``(start, kind, end)`` in order; ``kind``
    is a number into ``KINDS``."""
    rows = stored(scanned(docs, id_col, text_col))
    return judged(rows.where("base IS NOT NULL").select("doc_id", "base", "found"), dictionary_of(rows))


def listed(spans: str):
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def number_of(spans: str, kind: int):
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans."""
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[number_of("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )
