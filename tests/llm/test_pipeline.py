import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from mosaique.llm import decontaminate, pii, quality, simhash
from mosaique.llm.queries import PII_KEY

SF = "/root/testdata/sf0.001"


def test_stages_do_what_brute_force_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, df = [docs.toPandas()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == docs.columns
        frames.append(df.toPandas())
    before, judged, single, clean, private = frames
    accepted = {r["doc_id"] for r in quality.classify(docs).where("accepted").collect()}
    assert set(judged.doc_id) == accepted and 0 < len(accepted) < len(before)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    known = labels[labels.index.isin(before.doc_id)]
    assert (known == known.index.isin(accepted).astype(int)).mean() > 0.95
    fp = {r.doc_id: simhash.fingerprint(simhash.shingle_hashes(r.text)) for r in judged.itertuples()}
    group = {d: d for d in fp}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3 and root(a) != root(b):
            group[max(root(a), root(b))] = min(root(a), root(b))
    assert set(single.doc_id) == {d for d in fp if root(d) == d}
    items = [decontaminate.symbols(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    exact = {r.doc_id for r in single.itertuples() if any(i.tobytes() in decontaminate.symbols(r.text).tobytes() for i in items)}
    gone = set(single.doc_id) - set(clean.doc_id)
    assert exact <= gone
    for d in gone:
        text = decontaminate.symbols(single.set_index("doc_id").text[d])
        assert any(decontaminate.nearest(i, text)[0] <= decontaminate.RATE * len(i) for i in items)
    assert set(private.doc_id) == set(clean.doc_id)
    old = clean.set_index("doc_id").text
    for r in private.itertuples():
        found = pii.detect(old[r.doc_id])
        assert (r.text == old[r.doc_id]) == (not found) and r.n_chars == len(r.text)
        assert not any(old[r.doc_id][m.start : m.end] in r.text for m in found if len(m.norm) > 6)
    again = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(clean), PII_KEY).collect()}
    assert again == dict(zip(private.doc_id, private.text, strict=True))
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == len(private)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert fill.max() <= 2048 and np.mean(fill) > 1500


def test_rows_without_or_with_repeated_ids_are_judged_each(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = "the of and to in a is that house river stone walks under bright field tomorrow never quick garden letter".split()
    prose = lambda: " ".join(rng.choice(words, 60)).capitalize() + ", and so it is."
    good, junk = [prose() for _ in range(100)], [" ".join(rng.choice(words, 60)).upper().replace(" ", "$$$ ") for _ in range(20)]
    ids = [None] * 40 + [7] * 20 + list(range(100, 140))
    rows = [*zip(ids, good, strict=True), *[(None, t) for t in junk[:10]], *[(7, t) for t in junk[10:]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == sorted(good)
    copies = docs.where("text like '%so it is.'").union(spark.createDataFrame([(None, good[0]), (3, good[1]), (None, good[70]), (7, good[45])], docs.schema))
    single = corpus_pipeline.drop_near_copies(spark, copies, SF).collect()
    assert sorted(r["text"] for r in single) == sorted(good)
    assert {r["text"]: r["doc_id"] for r in single}[good[1]] == 3 and {r["text"]: r["doc_id"] for r in single}[good[70]] == ids[70]
    item = "what weighs more than seven grey elephants on a frozen northern lake"
    spark.createDataFrame([(None, item), (None, item + " in the spring"), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked = docs.union(spark.createDataFrame([(None, f"{good[0]} {item} {good[1]}"), (7, item)], docs.schema))
    assert sorted(r["text"] for r in corpus_pipeline.drop_benchmark_leaks(spark, leaked, str(tmp_path)).collect()) == sorted(t for _, t in rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Every stage on null columns, empty and very long texts, repeated rows, an empty table, and columns whose names clash with its own."""
    words = "the of and to in a is that house river stone walks under bright field tomorrow never quick garden letter".split()
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + ", and so it is."
    item = "what weighs more than seven grey elephants on a frozen northern lake"
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    normal = [(100 + k, prose(60), "s", 5) for k in range(60)]
    long, mail = prose(60_000), f"{prose(50)} Write to anna@smith.org, please."
    odd = [(None, normal[0][1], None, None), (None, None, None, None), (1, None, "s", 1), (2, "", "s", 0), (3, " \n\t", "s", 3), (4, long, None, len(long)), (4, long, None, len(long)), (5, mail, "s", 9), (None, f"{prose(60)} {item}", "s", 1)]
    schema = "doc_id long, text string, source string, n_chars long"
    docs = spark.createDataFrame(normal + odd, schema)
    for name, value in (("_mosaique_a", "x"), ("_mosaique_d", "d"), ("fp", "f"), ("h", "h"), ("votes", "v"), ("label", "l"), ("tokens", "t")):
        docs = docs.withColumn(name, F.lit(value))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    texts = [(r[0], r[1]) for r in normal + odd]
    tell = lambda rows: sorted(rows, key=str)
    assert tell(kept["quality classifier"]) == tell(x for x in texts if x[1] and x[1].strip())
    # Null, empty and blank texts have fingerprint zero and are one group; the row without an id is a copy of the first one.
    assert tell(kept["SimHash near-dedup"]) == tell([*[x for x in texts[:60]], (1, None), (4, long), (5, mail), texts[-1]])
    assert tell(kept["benchmark decontamination"]) == tell(texts[:-1])
    assert len(kept["PII surrogates"]) == len(texts)
    changed = set(kept["PII surrogates"]) - set(texts)
    assert len(changed) == 1 and next(iter(changed))[0] == 5 and "smith" not in next(iter(changed))[1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    ends = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.countDistinct("sequence_id", "offset").alias("places"), F.count(F.lit(1)).alias("pieces")).toPandas().set_index("doc_id")
    assert (ends.places == ends.pieces).all() and ends.n[2] == 1 and ends.n[1] == 1 and ends.n[4] > 2 * 60_000
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
