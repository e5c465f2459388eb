import random

import corpus_pipeline
from frameloom.llm import mixing, toxicity


def write_tables(spark, folder):
    rng = random.Random(13)
    mild, bad = [f"word{i}" for i in range(2000)], ["vile", "nasty", "rotten"]
    prose = lambda n: [rng.choice(mild) for _ in range(n)]
    docs, labels, planted = [], [], {"toxic": set(), "copy": set(), "repeat": set(), "leak": set()}
    item, passage = prose(30), prose(60)
    for i in range(700):
        words = prose(rng.randrange(60, 150))
        toxic = rng.random() < 0.25
        for _ in range(5 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
        if toxic:
            planted["toxic"].add(i)
    clean = [d for d in docs if d[0] not in planted["toxic"]]
    for k, kind in enumerate(["copy", "repeat", "leak"] * 8):
        i, words = 1000 + k, prose(120)
        planted[kind].add(i)
        if kind == "copy":
            words = rng.choice(clean)[1].split()
            words[rng.randrange(len(words))] = "changed"
        elif kind == "repeat":
            words[50:50] = passage
        else:
            item_words = list(item)
            item_words[7] = "swapped"
            words[30:30] = item_words
        docs.append((i, " ".join(words), "en", None if k % 5 == 0 else "s1", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, planted


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs, planted = write_tables(spark, str(tmp_path))
    sf_dir = str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "suffix_dedup", "decontamination", "mixing"]
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{sf_dir}/out-{name}")
        seen[name] = (at.collect(), (at := spark.read.parquet(f"{sf_dir}/out-{name}")).collect())

    def gone(name):
        before, after = seen[name]
        return {r.doc_id for r in before} - {r.doc_id for r in after}

    assert gone("toxicity") == planted["toxic"]
    assert gone("minhash") - {2001} == planted["copy"] and gone("suffix_dedup") == set()
    # the leaks share their passage, so the stage before has cut it from all but the first
    assert gone("decontamination") == {min(planted["leak"])}
    direct = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert {d[0] for d in docs} - {r.doc_id for r in direct.collect()} == planted["leak"]
    before = {r.doc_id: r.text for r in seen["suffix_dedup"][0]}
    cut = {r.doc_id: len(before[r.doc_id]) - len(r.text) for r in seen["suffix_dedup"][1] if r.text and r.text != before[r.doc_id]}
    assert set(cut) >= planted["repeat"] - {min(planted["repeat"])} and min(planted["repeat"]) not in cut
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"][1] if r.doc_id in cut)
    mixed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in at.collect()} and all(r.taken <= 2 * r.size for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, mixed))


def test_operators_are_what_the_stages_call(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rated = toxicity.rate_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.count() == rated.where("predicted = 0").count()
    assert corpus_pipeline.mix(spark, docs, str(tmp_path)).count() == mixing.mix_sources(docs).count()
