"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail, IP address, card and phone number) are found by fixed
patterns and are the seeds. Around each, the words to the left and right make
lexical patterns. A looser form of each kind (a phone number without a plus
sign, a card number that fails its checksum, an address with "(at)") gives
candidates with patterns of their own. Patterns and values form a graph that
Spark scores in rounds: a pattern's confidence is the share of score among the
distinct values seen in its place, a value's score grows with its confident
patterns, and a value of high score supports patterns like a seed in the next
round. Scores only rise, and rounds go on until none moves. Candidates that confident patterns name with a high score are added;
base spans always stay.

A text is read once for spans; the graph holds values and patterns only, is
combined before it is shuffled, and every round is written to the shared folder.

A loose number has 7 to 19 digits and is at most 40 characters long. Context
words are whole words; one of more than LONG characters counts as the word
`<long>`, and no word is looked for beyond it.

Defined cases: a null or empty text has no spans; repeated rows get equal spans
(rows are told apart by id and text hash); null ids take part; an empty table
gives no row; other columns are not read. Rows of equal id and text are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.common import row_batches
from rowferry.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9 ().\-/]{5,38}[0-9](?![0-9A-Za-z])")
LOOSE_AT = re.compile(r"@[A-Za-z0-9-]+| ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)*")

#: A pattern needs so many distinct values that are known by now (seeds, or of MIN_SCORE), and so much of its values' score.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8
#: A score moves if it changes by more.
STILL = 1e-6
#: Characters of the longest context word that is told from others.
LONG = 64


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run of local characters before its @ does, or where the last match ends."""
    at = 0
    for found in DOMAIN.finditer(text):
        sign = start = found.start()
        while start > at and text[start - 1] in LOCAL:
            start -= 1
        if start < sign:
            at = found.end()
            yield start, at


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the looser forms that touch no base span."""
    found = []
    for m in LOOSE_NUMBER.finditer(text):
        n = len(NOT_DIGIT.sub("", m[0]))
        if 7 <= n <= 19:
            found.append(("phone" if n < 13 else "card", *m.span()))
    for m in LOOSE_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
    taken = sorted((s, e) for _, s, e in base)
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: s[1]):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append((kind, start, end))
    return out


def _before(text: str, at: int) -> tuple[str | None, int]:
    """The word that ends before this place, and where it starts."""
    while at and text[at - 1].isspace():
        at -= 1
    near = text[max(0, at - LONG - 1):at].split()
    if not near:
        return None, 0
    return ("<long>", 0) if len(near[-1]) > LONG else (near[-1].lower(), at - len(near[-1]))


def _behind(text: str, at: int) -> str | None:
    """The word that starts behind this place."""
    while at < len(text) and text[at].isspace():
        at += 1
    near = text[at:at + LONG + 1].split()
    return (near[0].lower() if len(near[0]) <= LONG else "<long>") if near else None


def patterns(text: str, start: int, end: int) -> list[str]:
    """The two words to the left; the word on either side."""
    left, at = _before(text, start)
    if left is None:
        return []
    second = _before(text, at)[0]
    right = _behind(text, end)
    out = [f"{second} {left} _"] if second is not None else []
    return out + [f"{left} _ {right}"] if right is not None else out


def value(kind: str, text: str) -> str:
    return text.lower() if kind == "email" else NOT_DIGIT.sub("", text)


def joined(spans) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


ROW = pa.schema([
    ("doc_id", pa.int64()), ("hash", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()),
    ("seen", pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
        ("seed", pa.bool_()), ("patterns", pa.list_(pa.string())),
    ]))),
])
ROW_DDL = (
    "doc_id long, hash long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, seen array<struct<"
    "kind: string, start: int, end: int, value: string, seed: boolean, patterns: array<string>>>"
)


def _scan(batches):
    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text, hash_ in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    base = base_spans(text)
                    seen = [
                        {"kind": k, "start": s, "end": e, "value": value(k, text[s:e]), "seed": seed,
                         "patterns": patterns(text, s, e)}
                        for seed, spans in ((True, base), (False, loose_spans(text, base))) for k, s, e in spans
                    ]
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    yield doc_id, hash_, *counts, joined(base), seen

    return row_batches(rows(), ROW, lambda r: 64 + 200 * len(r[-1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: base spans, and all entities and candidates with their patterns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    return rows.mapInArrow(_scan, ROW_DDL)


def confident(occurrences: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, confidence) of confident patterns and (kind, value, score) of what they name.

    occurrences: kind, value, seed, patterns. rounds None: until no score moves.
    """
    edges = occurrences.select("kind", "value", "seed", F.explode("patterns").alias("pattern"))
    graph = materialize(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph")
    totals = graph.groupBy("pattern").agg(F.count("*").alias("total"))
    scores = graph.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("score"))
    done = 0
    while True:
        known = graph.join(scores.select("kind", "value", "score"), ["kind", "value"])
        mass = known.groupBy("kind", "pattern").agg(
            F.sum(F.round("score", 9).cast("decimal(20,9)")).cast("double").alias("mass"),
            F.sum((F.col("score") >= MIN_SCORE).cast("long")).alias("support"),
        )
        share = F.col("mass") / F.col("total")
        trusted = mass.join(totals, "pattern").where((F.col("support") >= MIN_SUPPORT) & (share >= MIN_CONFIDENCE))
        trusted = materialize(trusted.select("kind", "pattern", share.alias("confidence")), "pii-patterns")
        # A pattern that is not trusted adds nothing; least() would skip its null.
        doubt = F.when(F.col("confidence").isNotNull(), F.log1p(-F.least("confidence", F.lit(0.999))))
        doubt = F.sum(F.coalesce(F.round(doubt, 9), F.lit(0.0)).cast("decimal(20,9)")).cast("double")
        reached = known.join(trusted, ["kind", "pattern"], "left").groupBy("kind", "value")
        new = F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt))
        scores = materialize(reached.agg(new.alias("score"), F.max("score").alias("before")), "pii-scores")
        done += 1
        still = not scores.where(F.abs(F.col("score") - F.col("before")) > STILL).limit(1).count()
        if still or done == rounds:
            return trusted, scores.drop("before")


def discovered(scanned: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, hash and spans (array of kind, start, end) of documents in which patterns found something."""
    seen = scanned.select("doc_id", "hash", F.explode("seen").alias("s")).select("doc_id", "hash", "s.*")
    trusted, scores = confident(seen, rounds)
    named = seen.where(~F.col("seed")).withColumn("pattern", F.explode("patterns"))
    named = named.join(trusted, ["kind", "pattern"]).join(scores.where(F.col("score") >= MIN_SCORE), ["kind", "value"])
    return named.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("spans"))


def _text_of(spans: Column) -> Column:
    """Base spans and found ones as one text in order."""
    base = F.when(F.col("base") != "", F.split("base", ",")).otherwise(F.array().cast("array<string>"))
    parts = F.transform(base, lambda x: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index(x, ":", 1)).alias("k"),
        F.substring_index(F.substring_index(x, ":", 2), ":", -1).cast("int").alias("s"), x.alias("x"),
    ))
    more = F.transform(F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda x: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"),
        F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")).alias("x"),
    ))
    return F.array_join(F.transform(F.sort_array(F.concat(parts, more)), lambda x: x["x"]), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """doc_id, hash of the text, counts of base entities, base and all spans as text."""
    scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
    found = discovered(scanned, rounds).select(
        F.col("doc_id").alias("id2"), F.col("hash").alias("hash2"), F.col("spans").alias("more")
    )
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))
    rows = scanned.drop("seen").join(found, same, "left")
    return rows.select("doc_id", "hash", *[f"n_{k}" for k in KINDS], "base", _text_of(F.col("more")).alias("spans"))


def hidden(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] in place of each span; spans that overlap go together."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


HELPER = "__llm_found"


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data hidden in the text; length_col, if there, follows the text. A null text stays null."""
    @F.pandas_udf("string")
    def hide(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, more in zip(texts, found):
            spans = [] if text is None else base_spans(text)
            spans += [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in more.split(",") if x)]
            out.append(text and hidden(text, spans))
        return pd.Series(out, dtype="object")

    scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    found = discovered(scanned).select(
        F.col("doc_id").alias(f"{HELPER}_id"), F.col("hash").alias(f"{HELPER}_hash"), spans.alias(HELPER)
    )
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"{HELPER}_id")) & (
        F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(f"{HELPER}_hash")
    )
    rows = docs.join(found, same, "left")
    clean = {text_col: hide(text.cast("string"), F.coalesce(F.col(HELPER), F.lit("")))}
    rows = rows.withColumns(clean).select(*[F.col(f"`{c}`") for c in docs.columns])
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        rows = rows.withColumn(length_col, F.coalesce(F.length(text).cast(kind), F.col(f"`{length_col}`")))
    return rows
