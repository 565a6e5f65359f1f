"""Quality rules, line dedup, near-dedup, decontamination, mixing and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.llm import common, decontamination, linededup, mixing, neardup, quality, simhash

from . import helpers

SF = "/root/testdata/sf0.001"


def pairs(spark, n=None):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_quality_counts(spark):
    out = quality.quality_rules(helpers.frame(spark)).select("doc_id", "text", "q.*").collect()
    assert len(out) == len(helpers.rows())
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == helpers.quality(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(helpers.frame(spark, [])).count() == 0


def test_quality_lines(spark):
    prose = " ".join(f"w{i}" for i in range(60)) + "."
    menu = "Home | News | About us"
    texts = [prose + "\n" + menu, prose + ("\n" + menu + " ").join([""] * 40), prose.upper(), prose]
    out = quality.quality_rules(helpers.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])).orderBy("doc_id").select("q.*").collect()
    assert [r.kept for r in out] == [True, False, False, True]
    assert out[0].clean_text == prose


def test_quality_rules_by_line(spark):
    bad = ["One | Two | Three", "Home › News", "# # a", "so! so! so!", "ALL OF IT LOUD.", "12 34.5 6,7 items", "« - » - x y.", "see http://a.b www.c.d", "We use cookies here.", "Alle Rechte vorbehalten.", "Read more", "Wow" + "A" * 5000]
    good = ["A short end.", "Is it so?", "She ate a cookie and kept to herself.", "In 1984 there were 3 of them.", "He said: “no!”", "Über den Wolken ist es still.", "ÉTÉ comme hiver.", "", " \t", "A" * 5000 + "a."]
    prose = " ".join(f"wort{i}x" for i in range(400)) + "."
    texts = [prose + "\n" + x for x in bad + good]
    out = quality.quality_rules(helpers.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])).orderBy("doc_id").select("q.*").collect()
    assert [r.clean_text for r in out] == [prose] * len(bad) + texts[len(bad) :]


def test_quality_keeps_good_and_rejects_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    out = quality.quality_rules(docs).where("q.n_words >= 50 and not q.base_failed").groupBy("quality", "q.kept").count().collect()
    seen = {(r.quality, r.kept): r["count"] for r in out}
    assert seen.get((1, False), 0) == 0 and seen.get((0, True), 0) <= 0.02 * sum(v for (q, _), v in seen.items() if q == 0)


@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(spark, first):
    out = linededup.line_dedup(helpers.frame(spark), keep_first=first)
    assert out.columns[: len(helpers.frame(spark).columns)] == helpers.frame(spark).columns
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())
    data = Counter(r[:2] for r in helpers.rows())
    want = Counter()
    for r, n in zip(helpers.line_dedup(list(data), keep_first=first), data.values(), strict=True):
        want[r] += n
    assert got == want
    assert linededup.line_dedup(helpers.frame(spark, [])).count() == 0


def test_line_dedup_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.line_dedup(docs, 3).collect())
    assert got == sorted(helpers.line_dedup(pairs(spark), 3))


def test_near_stage_keeps_one_of_each_long_line(spark):
    import corpus_pipeline

    long, short = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(50))
    own = [" ".join(f"own{i}x{j}" for j in range(90)) for i in range(5)]
    texts = [f"{own[0]}\n{long}", f" {long.upper()}\t\n{own[1]}\n{short}", f"{own[2]}\n{short}\n{own[2]} {long}", f"{own[3]}\n{long}\n{long}", own[4], own[4]]
    docs = helpers.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])
    out = corpus_pipeline.near_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: texts[0], 1: f"{own[1]}\n{short}", 2: texts[2], 3: own[3], 4: own[4]}


def test_keep_bits_rebuild_the_text(spark):
    for r in linededup.line_dedup(helpers.frame(spark)).where("keep_bits is not null").collect():
        lines = r.text.split("\n")
        assert "\n".join(x for b in r.keep_bits for x in lines[b.start : b.start + b.len]) == r.kept_text


def test_fingerprints():
    for t in [None, "", " ", "A", "a B", "One two THREE four", "É é ß\tx\x0by\x1cz", "w " * 5000]:
        f = simhash.fingerprint(t)
        assert f % 2**64 == helpers.fingerprint(t)


def test_simhash_groups(spark):
    got = simhash.simhash_groups(helpers.frame(spark)).collect()
    assert len(got) == len(helpers.rows())
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == helpers.components([r[:2] for r in helpers.rows()])
    assert simhash.simhash_groups(helpers.frame(spark, [])).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in simhash.simhash_groups(docs).collect()) == helpers.components(pairs(spark))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_links_give_all_components(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:
        chain = v
        for _ in range(rng.randrange(8)):
            for _ in range(rng.choice([1, 2, 2, 3])):
                chain ^= 1 << rng.randrange(64)
            values.add(chain)
    values |= {0x1234567800000000 | rng.getrandbits(7) << 20 for _ in range(90)} | {rng.getrandbits(6) << 40 | 0x9ABC for _ in range(50)}
    own = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in own], "fp bigint"))
    assert edges.where("bit_count(a ^ b) > 2").count() == 0
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    array, group = np.array(own, np.int64).view(np.uint64), {v: v for v in own}
    changed = True
    while changed:
        changed = False
        for i, v in enumerate(own):
            for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 2):
                if group[own[j]] < group[v]:
                    group[v], changed = group[own[j]], True
    assert {v: roots.get(v, v) for v in own} == group


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1300)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[i] == 1000 for i in range(1001, 1300))


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 300])
def test_near_dedup_links_similar_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(150)) for _ in range(15)]
    for t in list(texts):
        for edits in (0, 1, 2, 3, 4, 6):
            words = t.split()
            for at in rng.sample(range(len(words)), edits):
                words[at] = "new"
            texts.append(" ".join(words))
    pairs = helpers.near_pairs(texts)
    least = list(range(len(texts)))
    while (now := [min([least[i], *(least[a + b - i] for a, b in pairs if i in (a, b))]) for i in range(len(texts))]) != least:
        least = now
    out = neardup.keep_one(helpers.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in out) == sorted(set(least)) and len(out) < len(texts) - 45
    assert any(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b]) for a, b in pairs)
    assert neardup.keep_one(helpers.frame(spark, [])).count() == 0


def test_near_dedup_probes_balls_of_whole_fingerprints(spark):
    """Without the tables of samples nine in ten of the pairs near the least similarity are linked, and of a large
    group of copies with a changed word all."""
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        other = [w if i % 48 != 24 else "new" for i, w in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
    words = [f"w{i}" for i in range(300)]
    texts += [" ".join([*words[:i], "new", *words[i + 1 :]]) for i in range(100)]
    sets = [neardup.shingles(t) for t in texts]
    alike = [len(np.intersect1d(sets[i], sets[i + 1])) / len(np.union1d(sets[i], sets[i + 1])) for i in range(0, 300, 2)]
    assert 0.8 <= min(alike) and max(alike) < 0.83
    docs = helpers.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])
    own = neardup.entries(docs).withColumn("keys", F.array().cast("array<bigint>"))
    place = {r.node: r.doc_id for r in own.collect()}
    got = {tuple(sorted((place[r.a], place[r.b]))) for r in neardup.links(docs, own).collect()}
    assert sum((i, i + 1) in got for i in range(0, 300, 2)) >= 135
    assert len([1 for a, b in got if a >= 300]) == 99 and all(b == a + 1 and a % 2 == 0 for a, b in got if a < 300)


def test_near_dedup_of_shared_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(1, a), (1, b), (1, b), (2, b), (None, a), (None, c), (None, c + " end"), (None, d), (3, d), (4, None), (None, "")]
    docs = helpers.frame(spark, [(i, t, *[None] * 7) for i, t in data])
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    ends = [x for x in got if x in {(None, c), (None, c + " end")}]
    assert len(ends) == 1 and got == Counter({x: 1 for x in [(1, a), (1, b), (3, d), (4, None), ends[0]]})


def test_near_stage_matches_brute_force(spark):
    import corpus_pipeline

    docs = corpus_pipeline.line_stage(spark, corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF).checkpoint()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = helpers.near_stage(texts)
    assert len(want) < len(texts) and any(want[d] != texts[d] for d in want)
    assert {r.doc_id: r.text for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == want


def test_tiling_matches_brute_force():
    rng = random.Random(5)
    for i in range(200):
        item = " ".join(rng.choice("abcd"[: 2 + i % 3]) for _ in range(rng.randrange(1, 30)))
        words = item.split()
        cut = rng.randrange(len(words))
        text = " ".join([*[rng.choice("abxy") for _ in range(9)], *words[cut:], "zz", *words[:cut], *[rng.choice("abcd") for _ in range(12)]])
        want = helpers.tiles(item, text)
        assert decontamination.tiles(decontamination.hashed(item), decontamination.hashed(text), min(5, len(words))) == want
        covered = sum(n for _, _, n in want)
        rows = [(1, 7, covered / len(words), len(want), covered)] if covered >= decontamination.THRESHOLD * len(words) else []
        assert list(decontamination.Block([(7, item), (8, "none of it is here"), (9, "")]).matches([(1, text), (2, "zz"), (3, "")])) == rows


def test_repeated_tokens_take_no_pairs():
    import time

    item, text = "la " * 400, "la " * 4000
    block, start = decontamination.Block([(1, item)]), time.perf_counter()
    assert list(block.matches([(2, text)])) == [(2, 1, 1.0, 1, 400)]
    assert time.perf_counter() - start < 0.5


def test_blocks_are_bounded_by_bytes():
    texts = ["a " * 3000, "x", "Word and other words. " * 500, "é" * 4000]
    for t in texts:
        assert decontamination.Block([(1, t)]).nbytes <= decontamination.BYTES_PER_CHAR * (len(t) + 1)


def test_reordered_sentences_are_caught():
    rng = random.Random(0)
    items = ["One two three four five six. Seven eight. Nine ten eleven twelve thirteen fourteen fifteen. Sixteen seventeen eighteen nineteen twenty more."]
    for _ in range(20):
        parts = re.findall(r"[^.]+\.", items[0])
        rng.shuffle(parts)
        assert list(decontamination.Block(list(enumerate(items))).matches([(1, "Before that. " + " Between. ".join(parts))]))


def test_contamination(spark):
    item = "The quick brown fox jumps over the lazy dog, while seven wizards vex a jolly gnome by night."
    halves = item.split(", ")
    texts = [None, "", item, "Before. " + item.upper() + " After.", f"{halves[1]} and then {halves[0]}", halves[0], "nothing here", item]
    docs = helpers.frame(spark, [(i if i < 7 else None, t, *[None] * 7) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "wizards vex", "x"), (None, item, None)], "item_id bigint, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.contamination(docs, bench).collect())
    whole = {2: 1, 3: 1, 4: 1, None: 1}
    assert got == Counter({(d, i): n for d, n in whole.items() for i in (1, 4, None)})
    assert {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()} == {0, 1, 5, 6}
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).count() == 0


def test_contamination_blocks_agree(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(decontamination, "CHUNK_CHARS", 3000)
    assert len(whole) >= 1 and sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == whole
    items = {r.item_id: r.text for r in bench.collect()}
    texts = dict(pairs(spark))
    assert {d for d, t in texts.items() for x in items.values() if x in t} <= {r[0] for r in whole}


def test_targets(spark):
    rng = random.Random(1)
    for sizes in [[1], [0], [5, 5, 5], [100, 1, 0, 3], *[[rng.choice([0, 1, 10, 1000, 50000]) for _ in range(rng.randrange(1, 12))] for _ in range(6)]]:
        names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
        out = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint")).collect()}
        assert [out[n] for n in names] == pytest.approx(helpers.water(sizes))


def test_mixing(spark):
    data = helpers.frame(spark)
    out = mixing.systematic(data).collect()
    assert len(out) == len(helpers.rows())
    assert all(0 <= r.copies <= 3 for r in out)
    assert sum(r["size"] for r in out) == sum(helpers.quality(r[1])[0] for r in helpers.rows())
    again = mixing.systematic(data.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.systematic(helpers.frame(spark, [])).count() == 0
    copies = defaultdict(int)
    for r in out:
        copies[r.doc_id, r.source, r._t] += r.copies
    taken = Counter((r.doc_id, r.source, r.h) for r in mixing.mix(data).withColumn("h", F.xxhash64("text")).collect())
    assert taken == Counter({k: n for k, n in copies.items() if n})


def test_mixing_meets_targets(spark):
    out = mixing.systematic(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for r in out.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= max(0.02 * r.target, 2 * r.most)


def test_pipeline_matches_plain_stages(spark):
    """Every stage written plainly, one after the other."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {d: t for d, r in rows.items() if (t := helpers.clean(r.text)) is not None}
    texts = {d: t for d, _, _, t in helpers.line_dedup(list(texts.items()), keep_first=True)}
    texts = helpers.near_stage(texts)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not helpers.contaminated(t, items)}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "copy"]
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(helpers.mixture(texts, {d: r.source for d, r in rows.items()}))
    assert all((r.lang, r.source, r.n_chars) == (rows[r.doc_id].lang, rows[r.doc_id].source, len(r.text)) for r in out)


def test_stages_take_awkward_rows(spark):
    """Null, empty, repeated and clashing rows pass every stage, and so does an empty table."""
    import corpus_pipeline

    for data in (helpers.frame(spark), helpers.frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, SF)
            assert out.columns == data.columns + (["copy"] if name == "mixing" else [])
            n = out.count()
            assert n == 0 if data.isEmpty() else n > 0
    texts = Counter(r[:2] for r in helpers.rows())
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, helpers.frame(spark), SF).collect())
    assert kept == Counter({(d, c): n for (d, t), n in texts.items() if (c := helpers.clean(t)) is not None})


def test_touched_and_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 100, i) for i in range(3000)], "k bigint, v bigint")
    names = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.col("k") * 2)
    want = Counter((r.k, r.v, r.k * 2) for r in rows.collect())
    assert Counter(map(tuple, common.join_spread(rows, names, "k").collect())) == want
    assert common.join_spread(rows.limit(0), names.limit(0), "k").count() == 0
    some = spark.createDataFrame([(100,), (None,)], "h bigint")
    for n in (common.BUCKETS, 1):
        monkeypatch.setattr(common, "BUCKETS", n)
        hit, rest = common.split_touched(rows, "k", some, "h")
        assert hit.union(rest).count() == 3000 and rest.where("k = 100").count() == 0
