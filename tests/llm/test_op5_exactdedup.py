import hashlib
import re

from llm_frames import MESSY, documents
from panelcast.llm import exactdedup
from pyspark.sql import functions as F

ROWS = MESSY + [(10, "ab c"), (11, "a b c "), (12, "abc"), (13, "a b  c"), (14, "abd"), (15, "é"), (16, "e\u0301")] + [(100 + i, "same again") for i in range(50)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        out.append((d, min(g)[3], len(g)))
    return sorted(out, key=str)


def store(spark, tmp_path, rows, files):
    path = f"{tmp_path}/docs"
    documents(spark, rows).repartition(files).write.parquet(path)
    return path


def check(spark, path, rows, **options):
    got = exactdedup.dedup(spark, path, **options).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({norm(t) for _, t in rows})  # one row of each group, also of repeated rows
    return got


def test_many_batches(spark, tmp_path):
    """One file a micro-batch: the state carries groups over."""
    got = check(spark, store(spark, tmp_path, ROWS, 9), ROWS, max_bytes=1)
    by = {r["doc_id"]: r["digest"] for r in got}
    assert by[12] == hashlib.sha256(b"abc").hexdigest()


def test_equal_digests_of_unequal_bytes(spark, tmp_path):
    check(spark, store(spark, tmp_path, ROWS, 3), ROWS, digest=lambda n: F.pmod(F.crc32(n.cast("binary")), F.lit(3)).cast("string"))


def test_one_file_and_empty_table(spark, tmp_path):
    path = store(spark, tmp_path, ROWS, 1)
    check(spark, next(str(p) for p in (tmp_path / "docs").glob("part-*.parquet")), ROWS)
    assert path
    empty = f"{tmp_path}/empty"
    documents(spark, []).write.parquet(empty)
    assert exactdedup.dedup(spark, empty).count() == 0


def test_rows_stay_whole(spark):
    df = documents(spark, ROWS)
    out = exactdedup.drop_copies(df)
    assert out.columns == df.columns and out.count() == len({norm(t) for _, t in ROWS})


def test_columns_of_any_name(spark):
    docs = documents(spark, MESSY).withColumnsRenamed({"file": "_metadata", "at": "__file", "word": "__row", "n": "a.`b"})
    kept = exactdedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(t) for _, t in MESSY})
