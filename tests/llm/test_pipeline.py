import random

import corpus_pipeline

from .test_operators import brute_components, brute_fingerprint, brute_windows, prose


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(1)
    base = [prose(rng, 120) for _ in range(30)]
    passage = prose(rng, 50, tag="p")
    texts = base + [base[3].replace(" ", "\n", 1), base[4], base[5] + " end", " ".join(w + "$$$" for w in base[6].split()), "short"]
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(3)] + [" ".join(w + "$$$" for w in prose(rng, 100).split()) for _ in range(12)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    bad = {k for k, t in enumerate(texts) if "$$$" in t}
    spark.createDataFrame([(k, int(k not in bad)) for k in range(len(texts))], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [k for k in range(len(texts)) if k not in bad and len(texts[k].split()) >= 50]
    stages = [kept]
    seen: set = set()
    stages.append([k for k in kept if not (" ".join(texts[k].split()) in seen or seen.add(" ".join(texts[k].split())))])
    fps = [brute_fingerprint(texts[k]) for k in stages[1]]
    stages.append([k for at, (k, c) in enumerate(zip(stages[1], brute_components(fps), strict=True)) if c == at])
    stages.append(stages[2])
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{n}"))
        docs = spark.read.parquet(str(tmp_path / f"out{n}"))
        assert sorted(r["doc_id"] for r in docs.collect()) == stages[n], n
    want = brute_windows([texts[k] for k in stages[2]], 35)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(left[k] == (w[2] if w[1] else texts[k]) for k, w in zip(stages[2], want, strict=True))
    assert sum(w[1] for w in want) == 150
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(stages[2])
