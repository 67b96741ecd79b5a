"""Personal data: base patterns, and identifiers in the contexts that these turn up in.

Base spans are found by the four expressions below. The found entities are seeds:
the words to their left and right, the word one further to the left, the word to
the left with the entity's own shape, and what stands before the `=` or `:`
inside a token, are lexical patterns. Patterns and instances (tokens with a digit or an
@) form a graph. Each round scores a pattern by the share of its distinct
instances that belong to a kind (those of none count half), and an instance by the patterns it has
(noisy or); patterns with at least SUPPORT seeds and CONFIDENCE name new
instances, which support patterns in the next round, until a round names none. Occurrences of instances
named by such a pattern are spans of that kind, unless they touch a base span.

Texts: null counts as empty. Any length: every scan is linear, and memory
follows the longest document. Repeated rows have the same spans. A null doc_id
is a value like others. An empty table gives no rows. Positions are code points,
ends exclusive. n_email to n_phone count base spans. Other columns are not read,
but mask() carries all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import giving_back, materialize

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5  # distinct seeds of a pattern
CONFIDENCE = 0.8
UNKNOWN = 0.5  # what an instance of no kind weighs in a pattern's share
DIGITS = 6  # an unseen identifier has as many digits, an unseen address an @
TOKEN = 64  # characters of a token or a neighbouring word at most: longer tokens count as no identifiers, as an address or number has fewer

# The base expressions. What may come before an @ is matched backwards from it, so that no text takes quadratic time.
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
EDGE = ".,;:!?()[]{}<>\"'`*#|"


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_SIGNS:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if SIGN.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def words_before(text: str, at: int) -> tuple[str, str]:
    """The word before a place, and the one before that."""
    near = ["", "", *text[max(0, at - 2 * TOKEN) : at].split()]
    return near[-1][-TOKEN:].strip(EDGE).lower(), near[-2][-TOKEN:].strip(EDGE).lower()


def shape(token: str) -> str:
    """Runs of digits as 9, runs of letters as a, other signs as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", token))


def word_after(text: str, at: int) -> str:
    near = text[at : at + TOKEN].split()
    return near[0].strip(EDGE).lower() if near else ""


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Tokens with a digit or an @, and all base spans, each with its patterns; base spans have a kind."""
    found = [(a, b, KINDS[k]) for a, k, b in spans]
    taken = [(a, b) for a, _, b in spans]
    pos, nth = 0, 0
    while m := SIGN.search(text, pos):
        at = m.start()
        end = SPACE.search(text, at)
        end = end.start() if end else len(text)
        before = re.split(r"\s", text[max(pos, at - TOKEN) : at])[-1]
        begin = at - len(before)
        while nth < len(taken) and taken[nth][1] <= begin:
            nth += 1
        pos = end
        if end - begin > TOKEN or any(a < end and b > begin for a, b in taken[nth : nth + 8]):
            continue
        token = text[begin:end]
        left = len(token) - len(token.lstrip(EDGE))
        token = token.strip(EDGE)
        name = re.match(r"[A-Za-z_]{2,24}[=:]", token)
        if name:
            left += name.end()
            token = token[name.end() :]
        if token:
            found.append((begin + left, begin + left + len(token), None))
    out = []
    for a, b, kind in found:
        name = re.search(r"([A-Za-z_]{2,24}[=:])\Z", text[max(0, a - 26) : a])
        (left, further), right = words_before(text, a), word_after(text, b)
        patterns = ["in " + name[1].lower()] if name else ["left " + left] if left else []
        if right and left:
            patterns.append(f"both {left} {right}")
        if left:
            patterns.append(f"shape {left} {shape(text[a:b])}")
        if further:
            patterns.append(f"gap {further}")
        out.append({"start": a, "end": b, "instance": text[a:b].lower(), "kind": kind, "patterns": patterns})
    return out


FOUND = "doc_id long, text_md5 string, n_email long, n_ip long, n_card long, n_phone long, base string, candidates array<struct<start: long, end: long, instance: string, kind: string, patterns: array<string>>>"


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Each document's base spans and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            rows = []
            for t in batch.column(2):
                text = t.as_py() or ""
                spans = base_spans(text)
                rows.append((*(sum(k == n for _, k, _ in spans) for n in range(4)), spelled(spans), candidates(text, spans)))
            cols = list(zip(*rows)) if rows else [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, pa.string(), kind])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "text_md5", "n_email", "n_ip", "n_card", "n_phone", "base", "candidates"])

    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "text").mapInArrow(giving_back(run), FOUND)


def plausible(instance: str, kind: str):
    """Whether a token may be of a kind at all."""
    return F.when(F.col(kind) == "email", F.col(instance).contains("@")).otherwise(F.regexp_count(instance, F.lit("[0-9]")) >= DIGITS)


def learn(occurrences: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that rounds of scoring leave. occurrences: instance, kind or null, pattern.

    Instances that a round names stay named, so rounds end: each but the last names one more at least.
    """
    edges = materialize(occurrences.select("pattern", "instance").distinct(), "edges")
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    seeds = materialize(occurrences.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    # Tables that grow with the documents are never broadcast; the confident patterns are, where they are small.
    totals, known, patterns = totals.hint("merge"), seeds, None
    while True:
        sums = edges.join(known.hint("merge"), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
        named = sums.groupBy("pattern").agg(F.sum("n").alias("named"))
        share = F.col("score") / (F.col("named") + UNKNOWN * F.greatest(F.col("total") - F.col("named"), F.lit(0)))
        scored = sums.where(F.col("n") >= support).join(totals, "pattern").join(named.hint("merge"), "pattern").withColumn("confidence", share)
        patterns = materialize(scored.where(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"), "patterns")
        # Noisy or: an instance fails a kind only if all of its patterns do.
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))))
        likely = edges.join(patterns, "pattern").where(plausible("instance", "kind"))
        new = likely.groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        more = materialize(new.where(F.col("score") >= confidence).join(known.select("instance", "kind").hint("merge"), ["instance", "kind"], "left_anti"), "named")
        if more.isEmpty():
            return patterns
        known = known.union(more)


def discovered(found: DataFrame) -> DataFrame:
    """Spans that confident patterns add: doc_id, text_md5 and more, an array of (start, kind, end), one row a text."""
    each = found.select("doc_id", "text_md5", F.explode("candidates").alias("c")).select("doc_id", "text_md5", "c.start", "c.end", "c.instance", "c.kind", F.explode("c.patterns").alias("pattern"))
    patterns = learn(each)
    new = each.where("kind is null").drop("kind").join(patterns, "pattern").where(plausible("instance", "kind"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    best = new.groupBy("doc_id", "text_md5", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return best.groupBy("doc_id", "text_md5").agg(F.sort_array(F.collect_set(F.struct("start", number.alias("kind"), "end"))).alias("more"))


def joined(left: DataFrame, more: DataFrame, md5: str = "text_md5", out: str = "more") -> DataFrame:
    """left with the array of discovered(), by doc_id and the column md5."""
    right = more.select(F.col("doc_id").alias("_vetta_id"), F.col("text_md5").alias("_vetta_of"), F.col("more").alias(out))
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_vetta_id")) & (F.col(md5) == F.col("_vetta_of")), "left").drop("_vetta_id", "_vetta_of")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, base and discovered."""
    found = materialize(scan(docs), "personal")
    rows = joined(found, discovered(found))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform("more", lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"]))
    # Base spans are in order already; only rows with discovered ones are ordered anew.
    every = F.array_sort(
        F.concat(F.filter(F.split("base", ","), lambda x: x != ""), spans),
        lambda a, b: F.when(F.split(a, ":")[1].cast("long") < F.split(b, ":")[1].cast("long"), -1)
        .when(F.split(a, ":")[1].cast("long") > F.split(b, ":")[1].cast("long"), 1)
        .otherwise(F.array_position(kinds, F.split(a, ":")[0]).cast("int") - F.array_position(kinds, F.split(b, ":")[0]).cast("int")),
    )
    joined_ = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(every, ","))
    n = sum((F.col(f"n_{k}") for k in KINDS), F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), joined_.alias("spans"), n.alias("n_spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with spans replaced by their kind; spans that overlap an earlier one only lengthen it."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all spans of the text replaced by their kind in angle brackets; all columns stay. Null texts stay null."""
    found = materialize(scan(docs.select("doc_id", F.col(text).alias("text"))), "personal")
    more = discovered(found)
    rows = joined(docs.withColumn("_vetta_md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), more, "_vetta_md5", "_vetta_more")

    @F.pandas_udf("string")
    def hide(texts, more):
        out = []
        for t, m in zip(texts, more):
            spans = base_spans(t or "")
            if m is not None:
                spans = sorted([*spans, *((x["start"], x["kind"], x["end"]) for x in m)])
            out.append(masked(t, spans) if t is not None and spans else t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    return rows.withColumn(text, hide(text, "_vetta_more")).select(*docs.columns)
