import random

import corpus_pipeline
from recordkeep.llm.language_id import fit_text_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    kinds = {"en": ["th", "er", "ing", "ou", "sh"], "fr": ["eau", "é", "qu", "oi", "ai"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, words(rng, kinds[lang], 120), lang, f"s{i % 3}"))
    item = words(rng, kinds["en"], 30)
    rows.append((100, rows[0][1], "fr", "s0"))  # a copy
    rows.append((101, rows[3][1] + " one more", "en", "s1"))  # a near copy
    rows.append((102, words(rng, kinds["en"], 40) + " " + item + " " + words(rng, kinds["en"], 40), "en", "s1"))  # a leak
    rows.append((103, "1234 ---", None, "s2"))  # no language
    rows.append((104, "a line that repeats\n" + words(rng, kinds["en"], 50), "en", "s2"))
    rows.append((105, "A line that repeats \n" + words(rng, kinds["en"], 50), "en", "s2"))
    rows.append((106, None, None, None))
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    every = {r[0] for r in rows}
    assert set(seen[0]) == every - {103, 106}
    assert set(seen[1]) == set(seen[0]) and seen[1][105].text == rows[65][1].split("\n")[1] and seen[1][104].text == rows[64][1]
    assert seen[1][105].n_chars == len(seen[1][105].text) and seen[1][100].text == ""
    assert every - {103, 106} - set(seen[2]) <= {100, 101} and 100 in seen[2]  # the copy lost its only line before
    assert set(seen[2]) - set(seen[3]) == {102}
    assert set(seen[4]) == set(seen[3])
    left = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == set(seen[4])
    assert fit_text_model(spark.read.parquet(str(tmp_path / "documents.parquet"))).languages == ["en", "fr"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
