"""The pipeline against brute force, and on odd rows."""

import random
import re

import __spark_entry__ as entry
import corpus_pipeline
from photonlake.llm import decontaminate, secrets, toxicity


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    source = {r.doc_id: r.text for r in docs.collect()}
    outs, out = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, small)
        assert out.columns == docs.columns, name
        outs.append({r.doc_id: r.text for r in out.collect()})
    mild, first, clean, masked = outs
    bad = {r.doc_id for r in toxicity.held_out_query(docs, labels).collect() if r.predicted}
    assert set(mild) == set(source) - bad
    sets = {i: shingles(t) for i, t in mild.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert all(alike(a, b) < 0.9 for a in first for b in first if a < b)
    assert all(any(alike(a, b) > 0.7 for b in mild if b != a) for a in set(mild) - set(first))
    folded = [decontaminate.fold(r.text)[0].tolist() for r in items.collect()]
    texts = {i: "".join(map(chr, decontaminate.fold(t)[0])) for i, t in first.items()}
    holding = {i for i, t in texts.items() if any("".join(map(chr, f)) in t for f in folded)}
    gone = set(first) - set(clean)
    assert holding <= gone
    for i in gone - holding:  # edited passages
        own = decontaminate.fold(first[i])[0].tolist()
        assert any(decontaminate.best_distance(f, own)[0] <= len(f) // 10 for f in folded)
    hidden = {i for i in clean if secrets.scan(clean[i] or "")}
    assert {i for i in clean if masked[i] != clean[i]} <= hidden and all(not secrets.scan(t)[:1] or "guess" in str(secrets.scan(t)) for t in masked.values())
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.collect()} == set(masked) and 0 < len(masked) < len(source)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, item = say(60), say(30)
    texts = [(1, a), (1, a), (2, a), (3, None), (4, ""), (None, say(20)), (5, f"{say(9)} {item} {say(9)}"), (6, "x password: kX9#vQ2!mZ7@ " + say(30)), (7, say(9000)), (8, say(40)), (8, say(40)), *((i, say(25)) for i in range(20, 40))]
    rows = [(i, t, "en", "s", len(t or ""), "q", 1, "z") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, key int, _bad string")
    for empty in (False, True):
        folder = tmp_path / str(empty)
        (docs.limit(0) if empty else docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([] if empty else [(i, i % 2, 0) for i in range(20, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([] if empty else [(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if empty:
            assert got == []
            continue
        ids = sorted(str(r.doc_id) for r in got if r.piece == 0)
        assert ids == sorted(["1", "3", "None", "6", "7", "8", "8", *map(str, range(20, 40))])
        out = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(folder))
        assert out.columns == docs.columns
        assert next(r.text for r in out.collect() if r.doc_id == 6).startswith("x password: [SECRET] ")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
