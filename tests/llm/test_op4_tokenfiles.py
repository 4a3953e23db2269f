import zlib

import numpy as np
from tokenizers import Tokenizer

from llm_frames import MESSY, documents
from panelcast.llm import tokenfiles
from panelcast.llm.subwords import ChunkEncoder, tokenizer_path


def ids_of(texts, end):
    tk = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, end] for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_round_trip(spark, tmp_path):
    manifest = tokenfiles.write_tokens(documents(spark, MESSY), f"file://{tmp_path}/t", length=16, batch=4, shards=3)
    got = sorted((tuple(r) for r in tokenfiles.read_documents(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in MESSY), key=lambda d: (d is not None, d or 0))
    want = {}
    for (d, t), ids in zip(MESSY, ids_of([t for _, t in MESSY], 1)):
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for d, at, n, crc in got:
        assert at == start and (n, crc) in want[d]
        start += n
    assert sum(r["n_tokens"] for r in manifest.collect()) == start


def test_random_access_without_copies(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)]
    manifest = tokenfiles.write_tokens(documents(spark, rows), f"file://{tmp_path}/t", length=8, batch=3, shards=1)
    (shard,) = manifest.collect()
    reader = tokenfiles.ShardReader(shard["ids_uri"])
    flat = np.concatenate(ids_of([t for _, t in rows], 1))
    for k in range(shard["n_sequences"]):
        ids, mask = reader.sequence(k)
        assert len(ids) == 8 and ids[mask].tolist() == flat[8 * k : 8 * k + 8].tolist()
        assert not ids.flags.owndata  # a view of the file
    assert reader.ids(5, 40).tolist() == flat[5:45].tolist()


def test_empty_table(spark, tmp_path):
    manifest = tokenfiles.write_tokens(documents(spark, []), f"file://{tmp_path}/t")
    assert manifest.count() == 0 and tokenfiles.read_documents(manifest).count() == 0


def test_chunks_encode_as_whole_texts():
    texts = [t for _, t in MESSY] + ["Don't stop, we'll GO... now!! ÄÖÜ straße;", "x" * 3000, "a–b “quoted” 3.14 #tag @me"]
    code = ChunkEncoder(tokenizer_path())
    for _ in range(2):
        ids, at = code.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x[:-1] for x in ids_of(texts, 0)]
    code.cache_chunks = 1
    ids, at = code.encode(texts[:1])
    assert ids.tolist() == ids_of(texts[:1], 0)[0][:-1]


def test_chunks_met_again_survive_a_full_store():
    code = ChunkEncoder(tokenizer_path(), cache_chunks=40)
    for batch in range(12):
        texts = [f"often, Often again. ÄRGER! it's 12 x{batch}y{i} word{chr(97 + batch)}{chr(97 + i)}; often," for i in range(9)] + [None, ""]
        ids, at = code.encode(texts)
        want = [e.ids for e in code.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert code.generation > 2 and "often," in code.slot and "x0y0" not in code.slot
    assert len(code.names) == len(code.slot)


def test_mixed_chunks_are_cut_without_the_library():
    chunks = ["to%%%", "und.34@Mail7.example.com", '"04dbEb91"', "555-7713", "(Élan_É)=`x`"]
    code = ChunkEncoder(tokenizer_path())
    want = code._library(chunks)
    asked = []
    code._library = lambda new: asked.extend(new) or want
    ids, at = code.encode([" ".join(chunks)])
    assert ids.tolist() == [i for x in want for i in x] and asked == []
    special = ["don't", "<|endoftext|>", "áb", "½a"]  # these still go through it
    code.encode([" ".join(special)])
    assert asked == special
