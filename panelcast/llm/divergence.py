"""How the word use of a source differs from its language and from other sources.

Every group (language, source) and every language gives each kept term a share in parts
of 10^9, smoothed by one. A group is compared with each other source of its language
over all terms, and with its language term by term. All arithmetic is in integers.

Top terms come from a dominance skyband. Of the terms a group uses more than its
language, one that is dominated by another (at least its count in the group, at most its
count in the language, earlier in UTF-8) ranks behind it. So a term dominated by k others
is not among the first k. Parts of a group keep the terms that fewer than k others
dominate; these skybands are merged in the same way, and only what is left is ranked.

Pairs of sources are summed over the terms both have; terms that only one or neither
has enter by how many there are with each count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import stage
from .text import text_batches

LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Terms in a part of a group (about), and how many parts' skybands are merged into one.
PART_TERMS, MERGED = 32_768, 16
#: Terms a task counts before it passes its counts on.
HELD_TERMS = 800_000
#: Pairs of groups a task sums before it passes its sums on, and terms it takes at a time.
HELD_PAIRS, TERMS_AT_ONCE = 1_000_000, 2048
#: Bytes below 0x80 that are no letters end a term; A-Z become a-z; the others stay.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are cut into terms at a time.
_CHUNK = 1 << 20


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in lists of bounded length, no term cut."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) as far as a task has counted; a row without a term
    for each group it has met."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            seen = docs[lang, source]
            terms = [None, *own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *own.values()], pa.int64()),
                    pa.array([0, *(seen[t] for t in own)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            own = counts[lang, source]
            distinct: set = set()
            for words in _chunks(text.as_py()):
                own.update(words)
                distinct.update(words)
            docs[lang, source].update(distinct)
        if sum(map(len, counts.values())) > HELD_TERMS:
            yield from flush()
    yield from flush()


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n (occurrences in the group) and total (in the lang) of the kept terms
    of every lang; also a row with a null term for every group. Nulls of all three columns
    count as empty. A term's rows are shuffled once, to where they are summed and judged."""
    text_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = own.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"total": F.sum("n").over(whole), "docs": F.sum("docs").over(whole)})
    return counts.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)) without rounding."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = wide(F.lit(UNIT)) * wide(n + 1), wide(total + terms)
    return F.lit(1).cast("bigint") + F.call_function("div", top, bottom)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


# Skyband


Kept = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Kept = (np.zeros(0, np.int64),) * 3


def skyband(n: np.ndarray, total: np.ndarray, k: int, kept: Kept = NONE, at_once: int = 256) -> tuple[np.ndarray, Kept]:
    """Which of the terms, given in UTF-8 order, fewer than ``k`` others dominate:
    terms earlier in the order with ``n`` at least and ``total`` at most theirs. ``kept`` holds
    the retained terms that come before all of them, as distinct (n, total) and how many
    have them; it is returned with what these terms add.

    Comparing with retained terms is enough: who dominates a dropped term dominates
    what that term dominates.
    """
    keep = np.zeros(len(n), dtype=bool)
    for i in range(0, len(n), at_once):
        a, b = n[i : i + at_once], total[i : i + at_once]
        before = ((kept[0][None, :] >= a[:, None]) & (kept[1][None, :] <= b[:, None])) @ kept[2]
        left = np.flatnonzero(before < k)
        a, b, before = a[left], b[left], before[left]
        among = np.tril((a[None, :] >= a[:, None]) & (b[None, :] <= b[:, None]), -1)
        own = before + among.sum(axis=1) < k  # kept whoever in the block is
        for j in np.flatnonzero(~own):
            own[j] = before[j] + (among[j] & own).sum() < k
        keep[i + left[own]] = True
        kept = _counted(*(np.concatenate(x) for x in zip(kept, (a[own], b[own], np.ones(own.sum(), np.int64)))))
    return keep, kept


def _counted(n: np.ndarray, total: np.ndarray, times: np.ndarray) -> Kept:
    order = np.lexsort((total, n))
    n, total, times = n[order], total[order], times[order]
    first = np.flatnonzero(np.r_[True, (np.diff(n) != 0) | (np.diff(total) != 0)][: len(n)])
    return n[first], total[first], np.add.reduceat(times, first) if len(first) else times


def _skybands(k: int):
    """Skybands of the parts in a task's rows, which come part by part and in UTF-8 order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = None, NONE
        for batch in batches:
            if not batch.num_rows:
                continue
            n, total = batch.column("n").to_numpy(), batch.column("total").to_numpy()
            keys = [batch.column(c).to_pylist() for c in ("lang", "source", "part")]
            keys = list(zip(*keys))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            mask = np.zeros(len(keys), dtype=bool)
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != part:
                    part, kept = keys[a], NONE
                mask[a:b], kept = skyband(n[a:b], total[a:b], k, kept)
            yield batch.filter(pa.array(mask))

    return run


def _retained(terms: DataFrame, parts: Column, k: int) -> DataFrame:
    """Skybands of ``parts`` parts of each group."""
    dealt = terms.withColumn("part", F.pmod(F.xxhash64("term"), parts))
    dealt = dealt.repartition("lang", "source", "part").sortWithinPartitions("lang", "source", "part", "term")
    return dealt.mapInArrow(_skybands(k), dealt.schema).drop("part")


def top_terms(terms: DataFrame, k: int = TOP, part_terms: int = PART_TERMS, merged: int = MERGED) -> DataFrame:
    """The first ``k`` terms of each group: lang, source, term, value, rank. ``terms`` has
    lang, source, term, n, total (occurrences in the group and in its language), p, q, and
    n_terms (terms of the group)."""
    parts = F.ceil(F.col("n_terms") / part_terms)
    fewer = F.ceil(parts / merged)
    band = _retained(_retained(terms.where("n > 0 and p > q"), parts, k), fewer, k).withColumn("value", distance(F.col("p"), F.col("q")))
    order = [F.col("value").desc(), F.col("term")]
    # Ranked in parts first, so that no task ranks a whole group.
    part = F.pmod(F.xxhash64("term"), fewer)
    first = band.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", part).orderBy(*order))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    return first.select("lang", "source", "term", "value", rank.alias("rank")).where(F.col("rank") <= k)


# Pairs of sources


def _floors(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For terms with several sources: what each pair of them adds over the case that only
    one of the two has the term. Sums wrap around at 64 bits."""
    sums: dict[tuple, int] = defaultdict(int)

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[i] for key in keys], pa.string()) for i in range(3)] + [pa.array([_wrapped(v) for v in sums.values()], pa.int64())],
            names=["lang", "source", "item", "value"],
        )
        sums.clear()

    for batch in batches:
        offsets = batch.column("groups").offsets.to_numpy()
        rows = batch.column("groups").flatten()
        sources = rows.field("source").dictionary_encode()
        names, code = sources.dictionary.to_pylist(), sources.indices.to_numpy()
        p, p0 = rows.field("p").to_numpy(), rows.field("p0").to_numpy()
        first, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs.tolist()):
            # one number per pair of this lang's sources; terms are taken by how many sources they have
            total = np.zeros(len(names) ** 2, dtype=np.int64) if len(names) <= 256 else None
            for size in np.unique(sizes[langs == lang]).tolist():
                terms = first[(langs == lang) & (sizes == size)]
                step = max(1, TERMS_AT_ONCE * 64 // (size * size))
                for i in range(0, len(terms), step):
                    at = terms[i : i + step, None] + np.arange(size)
                    for a in range(size):  # row by row of the pairs, so that memory stays small
                        pa_, p0a, ca = p[at[:, a]][:, None], p0[at[:, a]][:, None], code[at[:, a]][:, None]
                        q, q0, cb = p[at], p0[at], code[at]
                        add = _floors(pa_, q) - _floors(pa_, q0) - _floors(p0a, q) + _floors(p0a, q0)
                        pair = (ca.astype(np.int64) * len(names) + cb).ravel()
                        if total is not None:
                            np.add.at(total, pair, add.ravel())
                        else:
                            which, place = np.unique(pair, return_inverse=True)
                            part = np.zeros(len(which), dtype=np.int64)
                            np.add.at(part, place, add.ravel())
                            for c, v in zip(which.tolist(), part.tolist()):
                                sums[lang, names[c // len(names)], names[c % len(names)]] += v
            if total is not None:
                for c in np.flatnonzero(total).tolist():
                    sums[lang, names[c // len(names)], names[c % len(names)]] += int(total[c])
        if len(sums) > HELD_PAIRS:
            yield from flush()
    yield from flush()


def _wrapped(v: int) -> int:
    return (v + 2**63) % 2**64 - 2**63


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value. ``kept`` has lang, source, term, n,
    p and p0; ``groups`` has lang, source, p0 (its share of a term it lacks; null without
    terms in the lang), n_terms (kept terms it has), lang_terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("n_terms").alias("item_terms"))
    pairs = groups.join(other, "lang").where("source != item")  # the result's own rows
    wide = lambda c: c.cast("decimal(19,0)")
    none = wide(F.col("lang_terms") - F.col("n_terms") - F.col("item_terms")) * wide(distance(F.col("p0"), F.col("q0")))
    base = pairs.select("lang", "source", "item", F.coalesce(none, F.lit(0)).cast("decimal(38,0)").alias("value"))
    # Terms of one of the two, by how often it has them.
    counts = kept.where("n > 0").groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    one = pairs.select("lang", "source", "item", "q0").join(counts, ["lang", "source"])
    one = one.groupBy("lang", "source", "item").agg(
        F.sum(wide(F.col("times")) * wide(distance(F.col("p"), F.col("q0")))).cast("decimal(38,0)").alias("forth"),
        F.sum(wide(F.col("times")) * wide(distance(F.col("q0"), F.col("p")))).cast("decimal(38,0)").alias("back"),
    )
    forth = one.select("lang", "source", "item", F.col("forth").alias("value"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    shared = kept.where("n > 0").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("groups")).where("size(groups) > 1")
    both = shared.select("lang", "groups").mapInArrow(_common, "lang string, source string, item string, value bigint").where("source != item")
    both = both.withColumn("value", F.col("value").cast("decimal(38,0)"))
    total = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Sums of ``both`` hold up to multiples of 2^64.
    half, full = F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")
    return total.withColumn("value", (F.pmod(F.col("value") + half, full) - half).cast("bigint"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for each other source of the
    group's lang, ``term`` rows for the group's first ``k`` terms.

    Nulls in text, lang and source count as empty text; an empty lang or source is a
    group like any other. Terms are runs of ASCII letters and characters beyond ASCII, lower-cased
    in A-Z, of whole texts however long. A lang keeps the terms of at least ``least_docs`` of its
    documents. Groups without terms have pairs; their value is 0 where the lang keeps no term.
    Equal values rank by item in UTF-8 order. Repeated rows are documents of their own.
    An empty table gives no rows. Other columns are not read, so their names do not matter.
    """
    counts = stage(kept_terms(docs, least_docs), "kept-terms")
    kept = counts.where("term is not null")
    langs = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count("*").alias("lang_terms"), F.sum("total").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count("*").alias("n_terms"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("group_total", "n_terms", "lang_terms", "lang_total")])
    p0 = F.when(F.col("lang_terms") > 0, share(F.lit(0).cast("bigint"), F.col("group_total"), F.greatest(F.col("lang_terms"), F.lit(1))))
    groups = stage(groups.withColumn("p0", p0), "term-groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "total", "n_terms", "p0", share(F.col("n"), F.col("group_total"), F.col("lang_terms")).alias("p"),
        share(F.col("total"), F.col("lang_total"), F.col("lang_terms")).alias("q"),
    )
    by_pair = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(shares.select("lang", "source", "term", "n", "p", "p0"), groups)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_pair).alias("rank"))
    tops = top_terms(shares, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(tops)
