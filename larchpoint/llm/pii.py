"""Information-theoretic sanitisation of personal data.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Beyond them, the corpus tells which
terms give protected entities away: a term t that stands near an entity e discloses it to the degree
PMI(t, e) / IC(e) = log(c(t, e) N / (c(t) c(e))) / log(N / c(e)), all counted in documents. Terms that reach the
threshold, with support from several different contexts, are spans too, wherever they occur. `sanitise` replaces
entities by their kind (generalisation) and removes disclosing terms.

Two passes over all texts count: the first gathers (term, entity, context) where entities stand, the second counts in
how many documents the candidate terms occur. Candidates and disclosing terms reach the second pass as a bitmap of
fixed size (BITMAP buckets), which only saves work: exact joins decide. Disclosing terms are broadcast up to
BROADCAST_TERMS; beyond, they are joined to the texts that hold them.

Null and empty texts have no spans. Very long texts are handled in time linear in their length. Exact copies of a
context count once. Repeated rows are handled each for itself, and rows without doc_id too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchpoint.llm.common import bound_batches, column, keep, map_batches, table, texts_of

KINDS = ("email", "ip", "card", "phone", "term")
#: A term's characters on either side of an entity, line breaks included.
CONTEXT = 80
#: Disclosure from which a term is a span, and the different contexts that must support it.
THRESHOLD = 0.95
SUPPORT = 3
BITMAP = 1 << 20
BROADCAST_TERMS = 200_000

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]++")
_TERM = re.compile(r"(?=[0-9]*+[^\W\d_])[^\W_]{3,40}+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern: the part before an @ is the run of its characters back to the last match."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and kind; offsets in code points."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _NUMBER.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                at, parts = m.start(), m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    length = sum(map(len, four)) + 3
                    if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four):
                        out.append((at, 1, at + length))
                    at += length + 1
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity_of(text: str, kind: int) -> str:
    return f"{kind}:{text.lower()}" if kind == 0 else f"{kind}:{text}" if kind == 1 else f"{kind}:{''.join(_NUMBER.findall(text))}"


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, overlapping ones joined."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def meets(start: int, end: int, starts: list[int], ends: list[int]) -> bool:
    i = bisect_left(starts, end) - 1
    return i >= 0 and ends[i] > start


def near(text: str, start: int, end: int, covered: tuple[list[int], list[int]]) -> tuple[set[str], str]:
    """Terms near an entity, those in spans left out, and the context itself."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    terms = set()
    for m in _TERM.finditer(text, lo, hi):
        if (m.start() == lo and lo and text[lo - 1].isalnum()) or (m.end() == hi and hi < len(text) and text[hi].isalnum()):
            continue  # cut through by the edge
        if not meets(m.start(), m.end(), *covered):
            terms.add(m[0].lower())
    return terms, text[lo:start] + "\0" + text[end:hi]


def bitmap(df: DataFrame) -> np.ndarray:
    """Buckets that the long column `term` falls into: at most BITMAP numbers reach the driver."""
    out = np.zeros(BITMAP, bool)
    out[df.select(F.pmod("term", F.lit(BITMAP)).cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    return out


def disclosing_terms(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """term long: hashes of the terms whose disclosure of some entity reaches the threshold."""

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for n, text in enumerate(texts_of(batch)):
            spans, found = base_spans(text), set()
            covered = merged(spans)
            for a, kind, b in spans:
                e = hash64(entity_of(text[a:b], kind))
                terms, context = near(text, a, b, covered)
                c = hash64(context)
                found.add((None, e, c))
                found.update((hash64(t), e, c) for t in terms)
            rows += [(*x, n) for x in found]
        # Within a batch, a document counts once for a pair and once for an entity.
        pairs: Counter = Counter()
        for t, e in ((t, e) for t, e, _ in {(t, e, n): 0 for t, e, _, n in rows}):
            pairs[t, e] += 1
        first = {}
        for t, e, c, _ in rows:
            first.setdefault((t, e), set()).add(c)
        out = [(t, e, c, pairs[t, e] if i == 0 else 0) for (t, e), cs in first.items() for i, c in enumerate(sorted(cs))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], ["term", "entity", "context", "docs"])

    texts = docs.select("text")
    pairs = map_batches(texts, gather, "term long, entity long, context long, docs long")
    pairs = keep(pairs.groupBy("term", "entity", "context").agg(F.sum("docs").alias("docs")).groupBy("term", "entity").agg(F.count("*").alias("contexts"), F.sum("docs").alias("docs")).where((F.col("contexts") >= support) | F.col("term").isNull()))
    candidates = pairs.where(F.col("term").isNotNull())
    entities = pairs.where(F.col("term").isNull()).select("entity", F.col("docs").alias("entity_docs"))
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        marked = seen.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["term", "docs"])

        known: dict[str, int] = {}
        for batch in batches:
            for text in texts_of(batch):
                for t in set(_TERM.findall(text.lower())):
                    h = known.get(t)
                    if h is None:
                        if len(known) > 200_000:
                            known.clear()
                        h = hash64(t)
                        h = known[t] = h if marked[h % BITMAP] else 0
                    if h:
                        total[h] += 1
            total[0] += batch.num_rows
            if len(total) > 200_000:
                yield out()
                total.clear()
        if total:
            yield out()

    if not seen.value.any():
        return candidates.select("term")
    bound_batches(docs.sparkSession)
    counts = keep(texts.mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("term_docs")))
    rows = counts.where("term = 0").agg(F.sum("term_docs")).head()[0] or 1
    all_docs = F.lit(float(rows))
    pmi = F.log(F.col("docs") * all_docs / (F.col("term_docs") * F.col("entity_docs")))
    ic = F.log(all_docs / F.col("entity_docs"))
    return candidates.join(entities, "entity").join(counts, "term").where((ic > 0) & (pmi >= threshold * ic)).select("term").distinct()


def all_spans(text: str, terms: np.ndarray | set[int], known: dict[str, bool] | None = None) -> list[tuple[int, int, int]]:
    """Base spans and the spans of disclosing terms outside them."""
    base = base_spans(text)
    if not len(terms):
        return base
    out, known = list(base), {} if known is None else known
    covered = merged(base)
    for m in _TERM.finditer(text):
        t = m[0].lower()
        hit = known.get(t)
        if hit is None:
            if len(known) > 200_000:
                known.clear()
            hit = known[t] = hash64(t) in terms
        if hit and not meets(m.start(), m.end(), *covered):
            out.append((m.start(), 4, m.end()))
    out.sort()
    return out


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with entities generalised to [KIND] and disclosing terms removed; overlapping spans become one."""
    out, at = [], 0
    for a, kind, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "" if kind == 4 else f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def with_terms(docs: DataFrame, terms: DataFrame, fn, schema: str, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Apply fn(batch, list of term sets by row, known words or None) to docs, which keep their columns."""
    terms = keep(terms.distinct())
    if terms.count() <= limit:
        held = frozenset(terms.toArrow()["term"].to_pylist())
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, bool] = {}
            for batch in batches:
                if batch.num_rows:
                    yield fn(batch, [sent.value] * batch.num_rows, known)

        bound_batches(docs.sparkSession)
        return docs.mapInArrow(run, schema)
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(terms))

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {(i, h) for i, text in zip(column(batch, "name").to_pylist(), texts_of(batch), strict=True) for h in map(hash64, {m.lower() for m in _TERM.findall(text)}) if seen.value[h % BITMAP]}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 2)], ["name", "term"])

    # A text, named by its hash, has as many rows here as it has terms, and copies share theirs. Texts of one hash would
    # share them too, but only terms that stand in a text are looked for.
    name = F.xxhash64(docs["text"])
    per_text = map_batches(docs.select(name.alias("name"), "text"), words, "name long, term long").distinct().join(terms.hint("merge"), "term").groupBy("name").agg(F.collect_set("term").alias("__terms"))
    joined = docs.withColumn("__name", name).join(per_text.withColumnRenamed("name", "__name").hint("merge"), "__name", "left").drop("__name")
    return map_batches(joined, lambda b: fn(b.drop_columns(["__terms"]), [frozenset(x or ()) for x in column(b, "__terms").to_pylist()], None), schema)


def digests(batch: pa.RecordBatch, terms: list, known: dict | None) -> pa.RecordBatch:
    out = []
    for text, mine in zip(texts_of(batch), terms, strict=True):
        spans = all_spans(text, mine, known)
        say = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in xs)
        n = Counter(k for _, k, _ in spans)
        out.append((n[0], n[1], n[2], n[3], hashlib.sha256(say(x for x in spans if x[1] < 4).encode()).hexdigest(), say(spans), n[4]))
    cols = list(zip(*out, strict=True))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    return pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])


def find(docs: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return with_terms(plain, disclosing_terms(plain), digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long", limit)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with `text` sanitised; other columns as they are; null texts stay null."""

    def clean(batch: pa.RecordBatch, terms: list, known: dict | None) -> pa.RecordBatch:
        texts = [x and sanitised(x, all_spans(x, mine, known)) for x, mine in zip(column(batch, "text").to_pylist(), terms, strict=True)]
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, "text", pa.array(texts, pa.string()))

    return with_terms(docs, disclosing_terms(docs), clean, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
