import struct
import zlib

import corpus_pipeline as pipeline
from lexmill.llm import secrets
from lexmill.llm.queries import tokenizer_path

from .conftest import corpus, sentence
from .test_minhash import WORD, brute
from .test_secrets import base


def documents(rng):
    rows = []
    for d, t in corpus(rng):
        rows.append((d, t, "xx", rng.choice(["a", "b", None]), len(t) if t is not None else None))
    for i in range(60):
        rows.append((1000 + i, sentence(rng, 40, letters="stuvwxyz"), "yy", "hot", 200))
    rows += [(2000, f"{sentence(rng, 60)} token = abcdefgh12345678", "xx", "a", 100), (2001, "12 !! 99", "xx", "a", 8)]
    return rows


def shares(size, weight):
    """Targets by weight; what is above three times a source goes to the others, again and again."""
    target, free = {}, dict(size)
    while free:
        left = sum(size.values()) - sum(target.values())
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        full = [x for x in free if share[x] > 3 * size[x] + 1e-9]
        if not full:
            return target | share
        for x in full:
            target[x] = 3 * size[x]
            free.pop(x)
    return target


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage(spark, rng, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(documents(rng), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language ID", "MinHash near-dedup", "secret scans", "mixing sources", "best-fit packing"]
    before, seen = docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert out.columns == list(pipeline.COLUMNS)
        seen.append((before.collect(), out.collect()))
        before = out

    rows, kept = seen[0]  # language: what has letters stays, whole
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, ((r.doc_id, r.text) for r in rows if r.text and any(c.isalpha() for c in r.text))))
    assert {r.lang for r in kept} == {"xx", "yy"}

    rows, kept = seen[1]  # one document of each group
    comps = brute([(r.doc_id, r.text) for r in rows], 5, 80)
    expected = {(r.doc_id, r.text) for r in rows if r.doc_id is None or comps[r.doc_id][1] == r.doc_id}
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, expected))

    rows, kept = seen[2]  # secrets go, all else stays
    texts = {r.doc_id: r.text for r in kept}
    assert len(rows) == len(kept)
    for r in rows:
        found = base(r.text)
        assert (texts[r.doc_id] == r.text) == (not found)
        if found:
            assert base(texts[r.doc_id]) == [] and f"<{secrets.KINDS[found[0][1]]}>" in texts[r.doc_id]

    rows, kept = seen[3]  # sources near their targets, whole documents
    assert {r.text for r in kept} <= {r.text for r in rows}
    words = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r.source for r in rows}, key=lambda x: (x is None, x or ""))
    size = {x: sum(words(r.text) for r in rows if r.source == x) for x in sources}
    target = shares(size, {x: float(i % 3 + 1) for i, x in enumerate(sources)})
    for x in sources:
        most = max(words(r.text) for r in rows if r.source == x)
        assert abs(sum(words(r.text) for r in kept if r.source == x) - target[x]) <= most / 2 + 1 and target[x] <= 3 * size[x] + 1e-6

    rows, kept = seen[4]  # every token of every row is in a sequence
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected += [(r.doc_id, p // 4096, zlib.crc32(struct.pack(f"<{len(ids[p : p + 4096])}I", *ids[p : p + 4096]))) for p in range(0, len(ids), 4096)]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.ids_crc32)) for r in kept)

    again = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in again) == sorted((str(r.doc_id), r.piece, r.length) for r in kept)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
