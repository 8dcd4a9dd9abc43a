import pytest
from plain import brute_force

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) > 0.5 * docs.count()
        docs = docs.where(docs["doc_id"].isin(list(ids)))
    assert docs.count() < n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    whole = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in last.collect()}


def test_empty_tables(spark, tmp_path, sf):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_plain_versions(spark, sf):
    """Each stage against a plain version of itself over all rows of its own input."""
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from lacuna.llm import bpe, quality, toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def near(docs, rows):
        """Jaccard similarity of five-word shingle sets over all pairs."""
        words = {i: (t or "").lower().split() for i, t in rows.items()}
        sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
        kept = {}
        for i in sorted(sets):  # components by flooding
            if i in kept:
                continue
            todo, kept[i] = [i], i
            while todo:
                a = todo.pop()
                for b in sets:
                    if b not in kept and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                        kept[b] = i
                        todo.append(b)
        return set(kept.values())

    tox = lambda docs, rows: (s := toxicity.fit(docs, labels).scorer()) and {i for i, t in rows.items() if s(t) < 0.5}
    good = lambda docs, rows: (s := quality.fit(docs, labels).scorer()) and {i for i, t in rows.items() if s(t) >= 0.3}
    clean = lambda docs, rows: {i for i, v in brute_force(rows.items(), bench).items() if not v[4]}
    plain = {"toxicity": tox, "quality": good, "near_duplicates": near, "decontamination": clean}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept = {r["doc_id"]: r["text"] for r in stage(spark, docs, sf).collect()}
        assert set(kept) == plain[name](docs, rows), name
        assert all(rows[i] == t for i, t in kept.items())
        docs = docs.where(docs["doc_id"].isin(list(kept)))
    lib = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
