import zlib
from collections import defaultdict

import corpus_pipeline as pipe
import numpy as np

from tests.llm import brute
from tests.llm.test_native import verdicts

SF = "/root/testdata/sf0.001"


def brute_run(rows, items, path):
    """(doc_id, piece, start, length, crc) of the packed pieces, and the documents that are left."""
    from tokenizers import Tokenizer

    kept = [r for r, (_, ok) in zip(rows, verdicts(rows, 100), strict=True) if ok]
    groups = brute.duplicates([r[:2] for r in kept], 5)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    bad = {x[0] for x in brute.contamination([r[:2] for r in kept], items) if x[-1]}
    kept = [r for r in kept if r[0] not in bad]
    library, out = Tokenizer.from_file(path), set()
    return kept, library, out


def test_run_against_the_plain_version(spark, path):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, library, _ = brute_run(rows, items, path)
    got = pipe.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {r[0] for r in kept}
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    clean = [r for r in kept if not brute.secrets(r[1])[3]]
    assert len(clean) > 50
    for k, t, *_ in clean:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        assert sorted(pieces[k]) == [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    lengths = [p[2] for v in pieces.values() for p in v]
    assert len({r.sequence_id for r in got}) == brute.best_fit(lengths, 2048)


def test_stages_on_odd_rows(spark, docs, none):
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
        assert out.count() <= max(docs.count() * (1 if name != "best_fit_packing" else 1000), 1)
        assert stage(spark, none, SF).collect() == [], name


def test_one_document_of_each_group_stays(spark, docs):
    out = pipe.near_dedup(spark, docs, SF).select("doc_id").collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 900 not in ids
    assert sum(r.doc_id is None for r in out) == 3


def test_secrets_are_replaced(spark):
    d = spark.createDataFrame([(1, "x password=abc123xyz9 y", "en", "s", 23), (2, "clean text", "en", "s", 10), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pipe.secret_scans(spark, d, SF).collect()}
    assert got[1].text == "x password=[secret] y" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean text" and got[2].n_chars == 10 and got[3].text is None
    assert pipe.secret_scans(spark, d, SF).columns == d.columns


def test_names():
    assert [n for n, _ in pipe.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    assert pipe.ORACLE_SQL is None
