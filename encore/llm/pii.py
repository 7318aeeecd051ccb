"""Personal data by bootstrapped contextual extraction.

Four fixed patterns give the base spans (email, ip, card, phone): the seeds. Every seed, and every
other run that merely looks like an identifier, is an instance; the words around its occurrences are
lexical patterns of its kind. Spark scores the graph of patterns and instances in rounds: a pattern
is trusted by the share of seeds and trusted instances among all that it extracts (smoothed, and only
with enough different seeds), an instance by the noisy-or of its patterns. Occurrences of instances
that end above the threshold, and of seeds in another spelling, are added to the base spans, which
always stay.

A pattern is the word before and the word before that, or the word before with its punctuation and
the word after; a value's digits (its letters for emails, its numbers for addresses) name the instance, so the same
identifier in another spelling is the same instance. A run of numbers in which several identifiers
may be joined is split at its spaces, and every reading of its parts that has the digits of a phone
or a card is an instance of its own; all readings of a run together weigh as one extraction.

Defined cases: a null text is empty; spans are in code points, end exclusive; texts are read whole;
repeated rows are judged each; null ids are kept; an empty table gives an empty result. Only the id
and text columns are read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm.bpe import slices
from encore.llm.common import cut, map_texts, small_batches, table

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SMOOTHING = 2.0  # untrusted extractions that every pattern is charged with
MIN_SEEDS = 3  # different seeds a pattern needs
THRESHOLD = 0.8

# --- base patterns: fixed by the contract --------------------------------------------------------

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails where the run's first digit failed, and groups of digits are
# followed by no digit, so neither needs to be tried again: linear on any text.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @: the part before it is the whole run of
    its characters since the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- other runs that look like an identifier, and contexts ---------------------------------------

NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
AT = re.compile(r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?")
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\[dot\])[A-Za-z0-9-]++)*+")
DIGITS = re.compile(r"[0-9]+")
_DOT = r"(?:\x20?(?:\.|\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\{dot\})\x20?)"
OTHER_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?!\w)", re.IGNORECASE)
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,8}(?:[0-9A-Fa-f]{1,4})?(?![\w:])")
WORD = re.compile(r"\S+")
NAMED = 60  # longer context words stand in patterns by a digest of the whole word


def _other_mails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses of any length, grown from their marks outward."""
    done = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        host = HOST.match(text, m.end()) if start < m.start() else None
        if host:
            yield start, host.end()
            done = host.end()


def _parts(text: str, run: re.Match, covered: list[tuple[int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The separable parts ``(start, end, digits)`` of a run, in lists of neighbours: the run without
    what base spans cover, split at spaces and, where a part has more digits than any identifier, at
    every separator."""
    words, last, i = [], None, 0
    for m in DIGITS.finditer(text, *run.span()):
        a, b = m.span()
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i < len(covered) and covered[i][0] < b:
            last = None
            continue
        if last is None:
            words.append([[]])  # the run begins, or goes on after a base span
        elif "\x20" in text[last:a]:
            words[-1].append([])
        words[-1][-1].append((a, b))
        last = b
    for row in words:
        # part of a longer word or name, such as a hexadecimal token, is no identifier of a person
        before = row[0][0][0] - (text[row[0][0][0] - 1 : row[0][0][0]] == "(")
        if before and (text[before - 1].isalnum() or text[before - 1] in "_."):
            row = row[1:]
        if row and text[row[-1][-1][1] : row[-1][-1][1] + 1].isalnum():
            row = row[:-1]
        out = []
        for word in row:
            n = sum(b - a for a, b in word)
            out += [(word[0][0], word[-1][1], n)] if n <= 19 else [(a, b, b - a) for a, b in word]
        yield out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(kind, start, end, run)`` of what might be of a kind but is no base span, nor overlaps one.
    Neighbouring parts of a run of numbers are read together in every way that has 7 to 19 digits; the
    readings of a run share its number."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    out, i = [], 0
    for m in NUMBER.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        end = i
        while end < len(taken) and taken[end][0] < m.end():
            end += 1
        for parts in _parts(text, m, taken[i:end]):
            for k, (a, _, _) in enumerate(parts):
                a -= text[a - 1 : a] == "("
                plus = text[a - 1 : a] == "+" and not text[max(0, a - 2) : a - 1].isalnum()
                digits = 0
                for _, b, n in parts[k : k + 19]:  # a part has a digit at least
                    digits += n
                    if digits > 19:
                        break
                    if 7 <= digits <= 15:
                        out.append((3, a - plus, b, m.start()))
                    if digits >= 13:
                        out.append((2, a, b, m.start()))
    whole = []
    if "@" in text or "(at)" in text or "[at]" in text or "{at}" in text:
        whole += [(0, a, b) for a, b in _other_mails(text)]
    whole += [(1, m.start(), m.end()) for m in OTHER_IP.finditer(text) if all(int(p) <= 255 for p in DIGITS.findall(m[0]))]
    if ":" in text:
        whole += [(1, m.start(), m.end()) for m in IP6.finditer(text) if _ip6(m[0])]
    i = 0
    for kind, a, b in sorted(whole, key=lambda x: x[1]):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((kind, a, b, a))
    return out


def _ip6(value: str) -> str | None:
    """The usual form of an IPv6 address; None for other values and the address of zeros."""
    try:
        address = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return str(address) if int(address) else None


def instance(kind: int, value: str) -> str:
    if kind == 0:
        return re.sub(r"[^a-z0-9]", "", re.sub(r"\(at\)|\[at\]|\{at\}|\(dot\)|\[dot\]", "", value.lower()))
    if kind == 1:
        return _ip6(value) or ".".join(p.lstrip("0") or "0" for p in DIGITS.findall(value))
    return _digits(value)


def _plain(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())


def _names(text: str, pieces: set[tuple[int, int]], forward: bool) -> dict[tuple[int, int], str]:
    """What pieces of words are called in patterns: themselves, or a digest if they are long. Long pieces that
    begin (``forward``) or end together are digested in one pass, so that very many in one word stay linear."""
    out, long = {}, {}
    for a, b in pieces:
        if b - a <= NAMED:
            out[a, b] = _plain(text[a:b])
        else:
            long.setdefault(a if forward else b, []).append(b if forward else a)
    for at, others in long.items():
        h, done = hashlib.blake2b(digest_size=16), at
        for other in sorted(others, reverse=not forward):
            piece = _plain(text[done:other]) if forward else _plain(text[other:done])[::-1]
            h.update(piece.encode())
            done = other
            out[(at, other) if forward else (other, at)] = "#" + h.hexdigest()
    return out


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The lexical patterns around each occurrence, of whole words."""
    if not spans:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    near = []
    for a, b in spans:
        i, j = bisect_left(starts, a) - 1, bisect_right(ends, b)
        near.append((
            words[i - 1] if i > 0 else None,
            (starts[i], min(ends[i], a)) if i >= 0 else None,
            (max(starts[j], b), ends[j]) if j < len(words) else None,
        ))
    before = _names(text, {w for n in near for w in n[:2] if w}, True)
    after = _names(text, {n[2] for n in near if n[2]}, False)
    out = []
    for second, first, following in near:
        patterns = [f"{before[second]} {before[first]} _"] if second else []
        out.append(patterns + ([f"{before[first]} _ {after[following]}"] if first and following else []))
    return out


# --- Spark -------------------------------------------------------------------------------------

SPAN = "struct<kind:int,start:int,end:int>"
FOUND = "struct<kind:int,start:int,end:int,seed:boolean,instance:string,patterns:array<struct<pattern:string,weight:double>>>"


def key_of(text_col: str):
    """What spans depend on: the text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, base, found``: one pass over the texts."""
    rows = docs.select(id_col, text_col, key_of(text_col).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    pattern = pa.struct([("pattern", pa.string()), ("weight", pa.float64())])
    found = pa.struct([*span, ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pattern))])

    def one(text: str) -> tuple[list[dict], list[dict]]:
        base = base_spans(text)
        all_ = [(*s, None) for s in base] + candidates(text, base)
        around = contexts(text, [(a, b) for _, a, b, _ in all_])
        # a run charges a pattern once, however many readings of it the pattern extracts
        readings = Counter((run, k, p) for (k, _, _, run), ps in zip(all_, around) for p in ps if run is not None)
        return [dict(zip(("kind", "start", "end"), s)) for s in base], [
            {
                "kind": k,
                "start": a,
                "end": b,
                "seed": run is None,
                "instance": instance(k, text[a:b]),
                "patterns": [{"pattern": p, "weight": 1 / max(1, readings[run, k, p])} for p in ps],
            }
            for (k, a, b, run), ps in zip(all_, around)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                both = [one(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(2),
                        pa.array([x for x, _ in both], pa.list_(span)),
                        pa.array([x for _, x in both], pa.list_(found)),
                    ],
                    ["doc_id", "key", "base", "found"],
                )

    schema = f"doc_id {kind}, key binary, base array<{SPAN}>, found array<{FOUND}>"
    return map_texts(rows, run, schema)


def trusted(found: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Instances ``(kind, instance)`` with occurrences that are no base spans: those that end above the
    threshold, and seeds in another spelling, which score 1. ``found`` has one row per occurrence:
    ``kind, instance, seed, patterns``."""
    nodes = cut(found.groupBy("kind", "instance").agg(F.max("seed").alias("seed"), F.min("seed").alias("only")))
    edges = found.select("kind", "instance", F.explode("patterns").alias("p")).select("kind", "instance", "p.*")
    edges = edges.groupBy("kind", "instance", "pattern").agg(F.max("weight").alias("weight"))
    edges = cut(edges.join(nodes.drop("only"), ["kind", "instance"]))
    score = None
    for _ in range(rounds):
        if score is None:
            weighed = edges.withColumn("score", F.col("seed").cast("double"))
        else:
            weighed = edges.join(score, ["kind", "instance"], "left")
            weighed = weighed.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        pattern = weighed.groupBy("kind", "pattern").agg(
            F.sum(F.col("weight") * F.col("score")).alias("good"), F.sum("weight").alias("all"), F.sum(F.col("seed").cast("int")).alias("seeds")
        )
        pattern = pattern.where(F.col("seeds") >= MIN_SEEDS)
        pattern = pattern.select("kind", "pattern", (F.col("good") / (F.col("all") + SMOOTHING)).alias("trust"))
        reached = edges.where("not seed").join(pattern, ["kind", "pattern"])
        score = cut(
            reached.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        )
    respelled = nodes.where("seed and not only").select("kind", "instance")
    # stored, so that the join with the occurrences reads plain shuffles, of which a hot one can be split
    return cut(score.where(F.col("score") >= threshold).select("kind", "instance").unionByName(respelled))


def added(rows: DataFrame) -> DataFrame:
    """``key, more``: the spans that trusted patterns add to the texts of ``scanned`` rows; trusted
    readings of a run are all added, also where they overlap."""
    found = rows.select("key", F.explode("found").alias("f")).select("key", "f.*")
    more = found.where("not seed").join(trusted(found), ["kind", "instance"])
    more = more.select("key", F.struct("kind", "start", "end").alias("span")).distinct()
    # stored, so that the joins read plain shuffles, of which a hot text's partition can be split
    return cut(more.groupBy("key").agg(F.collect_list("span").alias("more")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, spans``; both arrays of ``(kind, start, end)`` by kind
    (a number into ``KINDS``), then start. ``spans`` holds the base spans and the added ones."""
    rows = cut(scanned(docs, id_col, text_col))
    empty = F.array().cast(f"array<{SPAN}>")
    return rows.join(added(rows), "key", "left").select(
        "doc_id",
        F.array_sort("base").alias("base"),
        F.array_sort(F.concat("base", F.coalesce("more", empty))).alias("spans"),
    )


def listed(spans: str):
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by the name of its first one's kind."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text masked; a null text stays null."""

    @F.pandas_udf("string")
    def masked(text: pd.Series, more: pd.Series) -> pd.Series:
        def one(t, m):
            extra = [(x["kind"], x["start"], x["end"]) for x in m] if m is not None else []
            return None if t is None else mask(t, base_spans(t) + extra)

        return pd.Series([one(t, m) for t, m in zip(text, more)], dtype=object)

    small_batches(docs.sparkSession)
    more = added(cut(scanned(docs, id_col, text_col))).select(F.col("key").alias("__key"), F.col("more").alias("__more"))
    rows = docs.join(more, key_of(text_col) == F.col("__key"), "left")
    return rows.withColumn(text_col, masked(F.col(text_col), F.col("__more"))).select(docs.columns)


def number_of(spans: str, kind: int):
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans."""
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[number_of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
