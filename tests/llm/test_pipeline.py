import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.test_ops import DOCS, docs, groups_by_hand, leaks_by_hand, prose


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mix", "shards"] and C.ORACLE_SQL is None


def make(spark, folder):
    rng = random.Random(11)
    items = [(i, prose(rng, 25, 5000)) for i in range(5)]
    texts = [prose(rng, 40, 5000) + (" vile" * 3 if i % 3 == 0 else "") for i in range(600)]
    texts += [prose(rng, 50, 5000) for _ in range(40)]
    texts += [texts[601], texts[602] + " tail", texts[603].upper()]
    texts += [prose(rng, 20, 5000) + ". " + items[k][1] + "! " + prose(rng, 20, 5000) for k in range(5)] + [items[0][1].upper(), None, "", "short"]
    d = docs(spark, texts, {i: "abc"[i % 3] for i in range(len(texts))})
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts, items


def test_each_stage_does_its_job(spark, tmp_path):
    texts, items = make(spark, tmp_path)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = C.drop_toxic(spark, d, str(tmp_path))
    assert kept.columns == d.columns
    toxic = {i for i in range(600) if i % 3 == 0}
    assert len(ids(kept) & toxic) <= 4 and len(ids(d) - ids(kept) - toxic) <= 2
    one = C.drop_near_duplicates(spark, d, str(tmp_path))
    groups = groups_by_hand(texts, 5, 80, 100)
    assert ids(one) == {i for i, (_, root) in enumerate(groups) if root == i} and one.columns == d.columns
    clean = C.drop_benchmark_passages(spark, d, str(tmp_path))
    rows = {r.doc_id: r for r in clean.collect()}
    hits = [n for _, n, _ in leaks_by_hand(texts, items)]
    assert set(rows) == {i for i in range(len(texts)) if not (hits[i] and not texts[i].upper().replace(items[0][1].upper(), "").strip())}
    assert all((r.text, r.n_chars) == (texts[i], len(texts[i] or "")) for i, r in rows.items() if not hits[i])
    assert not any(n for _, n, _ in leaks_by_hand([r.text for r in rows.values()], items)) and all(len(r.text or "") == r.n_chars for r in rows.values())
    assert C.mix(spark, d, str(tmp_path)).columns == d.columns


def test_run_from_end_to_end(spark, tmp_path):
    texts, items = make(spark, tmp_path)
    out = C.run(spark, str(tmp_path))
    rows = out.collect()
    assert rows and set(DOCS.replace(",", "").split()[::2]) <= set(out.columns)
    assert not any(n for _, n, _ in leaks_by_hand([r.text for r in rows], items))
    assert out.groupBy("shard", "shard_rows").agg(F.count("*").alias("n")).where("n <> shard_rows").count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    texts, _ = make(spark, tmp_path)
    names = ("score", "predicted", "leak", "words", "n_grams", "size", "source_size", "target", "copies", "doc", "kept", "component_id", "n", "path", "run", "_k", "row")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in C.STAGES:
        out = stage(spark, d, str(tmp_path))
        assert [c for c in out.columns if c in d.columns] == d.columns, name
        assert out.select(*names).distinct().collect() == [tuple(f"own {c}" for c in names)], name
        if name != "shards":
            assert out.columns == d.columns, name


def mixed_by_hand(rows):
    """Copies of each row by the text's rule: weights by source, targets under three times the size, copies by prefix sums."""
    import math

    from tallyweave.llm import mix_sources as m

    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for i, r in enumerate(rows)}
    name = lambda r: "1" if r.source is None else "0" + r.source
    total = Counter()
    for i, r in enumerate(rows):
        total[name(r)] += size[i]
    weight = {s: m.WEIGHTS[k % 3] for k, s in enumerate(sorted(total))}
    target, open_, left = {}, set(total), sum(total.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * total[s] < weight[s] * share}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 3 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        open_ -= full
    copies, blocks = Counter(), max(1, -(-len(rows) // m.BLOCK_ROWS))
    for s in total:
        own = [i for i, r in enumerate(rows) if name(r) == s]
        own.sort(key=lambda i: (h(m.SEED + str(rows[i].doc_id)) % blocks, size[i], rows[i].doc_id))
        rate, shift = (target[s] / total[s] if total[s] else 0.0), h(m.SEED + s) / (1 << 28)
        for k, i in enumerate(own):
            copies[rows[i].doc_id] += min(3, math.floor(rate * (k + 1) + shift) - math.floor(rate * k + shift))
    return copies


def test_mix_as_by_hand(spark, tmp_path, monkeypatch):
    from tallyweave.llm import mix_sources

    make(spark, tmp_path)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = d.collect()
    for n in (mix_sources.BLOCK_ROWS, 100):
        monkeypatch.setattr(mix_sources, "BLOCK_ROWS", n)
        got = Counter(r.doc_id for r in C.mix(spark, d, str(tmp_path)).collect())
        assert got == +mixed_by_hand(rows)


def test_run_leaves_its_result_only(spark, tmp_path):
    from pathlib import Path

    from tallyweave.llm import common

    make(spark, tmp_path)
    common.clean_up(spark)
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    C.run(spark, str(tmp_path))
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["pipeline", "shards"]
    common.clean_up(spark)
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["shards"]


def test_run_on_empty_tables(spark, tmp_path):
    make(spark, tmp_path / "full")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert C.run(spark, str(tmp_path / "none")).count() == 0


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    make(spark, tmp_path)
    d = spark.createDataFrame([(5, "a b c d e f", "en", "s", 11)] * 3 + [(None, None, None, None, None)] * 2, DOCS)
    got = C.drop_near_duplicates(spark, d, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "None", "None"]
