"""Every corpus query against a plain version, on small tables with odd rows and on supplied tables."""

import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import catalog, components, decontaminate, entropy_mix, outliers, packed_tokens, simhash, suffix_tree_lm

SMALL = "/root/testdata/sf0.001"
TEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "no id here"), (5, "same words here\nsame words here\n\nsame words here"), (6, "x " * 3000)]


def fetched(spark, name, folder):
    return sorted((r.asDict() for r in catalog.QUERIES[name](spark, folder).collect()), key=repr)


def documents(spark, folder=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def in_duckdb(name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLES[name])
    return sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=lambda d: repr({k: d[k] for k in rel.columns}))


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith("op")))
def test_empty_tables(spark, tables, name):
    folder = tables.folder(f"empty-{name}")
    assert catalog.QUERIES[name](spark, folder).collect() == []


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_benchmark_hits", "op6_url_filter"])
def test_sql_on_odd_rows(spark, tables, name):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [*ODD, (7, f"before {passage.upper()}, after {passage}"), (8, "Released under the MIT License.\nreleased UNDER the mit licence."), (9, "é tiny item É"), (10, "Licensed under CC BY 4.0.")]
    items = [(1, passage), (2, passage), (None, passage), (3, "tiny item"), (4, None), (5, "..."), (6, "absent words only")]
    pages = [(k, u, None) for k, u in enumerate(["http://a.b.example.com/x", "HTTPS://User@B.example.com:80/", None, "", "not a url", "ftp://localhost/a", "http://q.example.net?x"] * 40)]
    folder = tables.documents(f"odd-{name}", docs, benchmark=items, pages=[*pages, *pages[:3]])
    columns = catalog.QUERIES[name](spark, folder).columns
    mine = sorted((repr({k: r[k] for k in sorted(columns)}) for r in fetched(spark, name, folder)))
    theirs = sorted((repr({k: r[k] for k in sorted(columns)}) for r in in_duckdb(name, folder)))
    assert mine == theirs and len(mine) > 5


def base_statistics(text):
    own = TEN.findall(text or "")
    at = {}
    for i in range(len(own) - 2):
        at.setdefault(tuple(own[i : i + 3]), []).append(i)
    covered = {i + d for places in at.values() if len(places) > 1 for i in places for d in range(3)}
    lines = [x for x in (text or "").split("\n") if TEN.search(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, tables):
    rows = [*ODD, *documents(spark)]
    folder = tables.documents("statistics", rows)
    got = fetched(spark, "op4_robust_outliers", folder)
    plain = []
    for row in rows:
        n, chars, symbols, lines, repeated = base_statistics(row[1])
        plain.append((row[0], n, chars, symbols, lines, repeated, n < 50 or 100 * repeated > 50 * n))
    mine = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]
    assert sorted(mine, key=repr) == sorted(plain, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_robust_distances_match_plain(spark):
    draw = np.random.default_rng(1)
    x = np.vstack([draw.normal(size=(300, 2)) @ [[1, 0.6], [0, 0.5]], draw.normal(8, 0.1, size=(60, 2))])
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "__group string, a double, b double")
    got = outliers.robust_distances(df, ["a", "b"]).toPandas()
    d2 = np.array([got.loc[(got.a == a) & (got.b == b), "__d2"].iloc[0] for a, b in x])
    clean, planted = d2[:300], d2[300:]
    assert planted.min() > 3 * np.quantile(clean, 0.99)
    # The distances are those of the fitted half: an affine map of the clean part's own covariance.
    own = x[:300] - x[:300].mean(0)
    classic = np.einsum("ij,jk,ik->i", own, np.linalg.inv(np.cov(own.T)), own)
    assert np.corrcoef(classic, clean)[0, 1] > 0.95


@pytest.mark.parametrize("share", [0.1, 0.3, 0.45])
def test_robust_half_withstands_junk(spark, share):
    draw = np.random.default_rng(2)
    n = int(400 * share)
    x = np.vstack([draw.normal(size=(400 - n, 3)), draw.normal(9, 0.2, size=(n, 3))])
    df = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)], "__group string, i int, a double, b double, c double")
    d2 = outliers.robust_distances(df, ["a", "b", "c"]).orderBy("i").toPandas()["__d2"].to_numpy()
    assert d2[400 - n :].min() > 2 * d2[: 400 - n].max()


def test_small_groups_are_judged_by_wider_estimates(spark):
    """A group below the least size is judged by its language, a small language by the whole table, a small table not at all."""
    draw = np.random.default_rng(3)
    words = [f"w{'abcdefgh'[i % 8] * (1 + i % 7)}" for i in range(300)]
    text = lambda n: " ".join(draw.choice(words, size=n))
    rows = [(i, text(int(draw.integers(60, 200))), "en", "a" if i < 60 else f"s{i}") for i in range(100)]
    rows += [(200 + i, text(90), None, None) for i in range(4)]
    places = [("en", "a"), ("en", "s999"), (None, None), ("xx", "a")]
    marked = [(900 + i, " ".join(f"{w}###" for w in text(120).split()), *place) for i, place in enumerate(places)]
    schema = "doc_id long, text string, lang string, source string"
    got = {r["doc_id"]: r for r in outliers.judged(spark.createDataFrame(rows + marked, schema)).collect()}
    assert len(got) == len(rows) + len(marked)
    assert sorted(i for i, r in got.items() if not r["kept"] and not r["base_failed"]) == [900, 901, 902, 903]
    few = outliers.judged(spark.createDataFrame(rows[:20] + marked[:1], schema)).collect()
    assert all(r["kept"] and r["distance2"] is None for r in few)
    assert outliers.judged(spark.createDataFrame([], schema)).count() == 0


def capped(sizes, weights, total, most=2):
    """Reshare the excess by weight, round by round."""
    target, fixed, left = {}, set(), total
    while True:
        free = [k for k in sizes if k not in fixed]
        level = left / sum(weights[k] for k in free) if free else 0
        over = [k for k in free if weights[k] * level > most * sizes[k]]
        if not over:
            return target | {k: weights[k] * level for k in free}
        for k in over:
            target[k] = most * sizes[k]
            fixed.add(k)
            left -= target[k]


def test_mix(spark, tables):
    sources = [None, "é", "a", "a", "a", "b", None, "Z"]
    rows = [*[(*r, "en", s) for r, s in zip(ODD, sources)], *[(r[0] + 100, *r[1:]) for r in documents(spark)]]
    folder = tables.documents("mix", rows)
    got = fetched(spark, "op5_entropy_mix", folder)
    assert got == fetched(spark, "op5_entropy_mix", folder)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(TEN.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = capped(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(got) == len(rows)
    for s, words in taken.items():
        shortest = min((r["size"] for r in got if source[r["doc_id"]] == s and r["size"]), default=0)
        assert abs(words - target[s]) <= max(shortest, 0.05 * target[s]), s


def test_mix_rates_are_tilted(spark):
    draw = np.random.default_rng(2)
    size = draw.integers(1, 400, 500)
    df = spark.createDataFrame([(k, "s", int(v)) for k, v in enumerate(size)], "doc_id long, source string, n long")
    out = entropy_mix.mixed(df, F.col("n"), lambda t: t.withColumn("target", F.col("source_size") * 0.6)).toPandas()
    slope = np.log(out.rate) / out["size"]
    assert np.allclose(slope, slope.iloc[0]) and slope.iloc[0] < 0
    assert (out.rate * out["size"]).sum() == pytest.approx(0.6 * size.sum(), rel=1e-5)


def test_token_files(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*ODD, *documents(spark), (900, "a  b\n\n c \n d\n"), (901, "'s 's\n's <|endoftext|>"), (902, "é² x½_y a_b 12٣ 3 ' s")]
    folder = tables.documents("tokens", rows)
    got = sorted(fetched(spark, "op7_packed_tokens", folder), key=lambda r: r["start"])
    coder = Tokenizer.from_file(public_tokenizers.path(packed_tokens.TOKENIZER))
    start = 0
    for r, row in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        ids = [*coder.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (row[0], start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_read_back(spark, tables, tmp_path):
    path = str(tmp_path / "ids")
    packed_tokens.write_ids(spark.createDataFrame([(k, "a b " * k) for k in range(50)], "doc_id long, text string"), path)
    rows = packed_tokens.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(50)) and all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(50)]


def test_token_files_hand_over_small_batches(spark, tmp_path, monkeypatch):
    def noting(of, kind, folder=str(tmp_path)):
        def run(batches):
            import uuid

            def noted():
                for batch in batches:
                    with open(f"{folder}/{kind}-{uuid.uuid4().hex}", "w") as out:
                        out.write(str(batch.nbytes))
                    yield batch

            yield from of(noted())

        return run

    monkeypatch.setattr(packed_tokens, "_encoder", lambda *args, of=packed_tokens._encoder: noting(of(*args), "texts"))
    monkeypatch.setattr(packed_tokens, "_checksums", noting(packed_tokens._checksums, "ids"))
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(key, None) for key in keys]
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 6000).alias("text"))
    packed_tokens.write_ids(docs, str(tmp_path / "files"))
    assert packed_tokens.checksummed(spark, str(tmp_path / "files")).count() == 1200
    for kind, least in (("texts", 1200 * 30000), ("ids", 1200 * 24000)):
        sizes = [int(path.read_text()) for path in tmp_path.glob(f"{kind}-*")]
        assert sum(sizes) >= least and max(sizes) < 6 << 20
    assert [spark.conf.get(key, None) for key in keys] == before


def test_encoding_takes_one_thread():
    code = """if True:
        import os, public_tokenizers
        from eventide.llm import packed_tokens
        threads = len(os.listdir("/proc/self/task"))
        encoder = packed_tokens.PartEncoder(public_tokenizers.path(packed_tokens.TOKENIZER))
        list(encoder([" ".join(f"w{k}x" for k in range(n, n + 5000)) for n in range(0, 20000, 5000)], 2))
        print(len(os.listdir("/proc/self/task")) - threads)"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {key: value for key, value in os.environ.items() if key not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0"]


def plain_simhash(text):
    import xxhash

    own = TEN.findall((text or "").translate(LOWER))
    span = min(3, len(own))
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + span]).encode(), 42) for i in range(len(own) - span + 1)] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [512, 0])
def test_simhash(spark, tables, crowd):
    rows = [*ODD, *documents(spark)]
    base = rows[20][1].split()
    for k in range(30):
        edited = list(base)
        edited[k * 3 % len(edited)] = "edited"
        rows.append((1000 + k, " ".join(edited)))
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = simhash.near_duplicates(df, crowd).collect()
    fps = [plain_simhash(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    plain = sorted(((rows[a][0], fps[a], least[find(a)]) for a in range(len(rows))), key=repr)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=repr) == plain


def test_components_of_a_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7, 6)]
    got = {r.node: r.least for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}


def test_simhash_stage_keeps_one(spark):
    rows = [(1, "a b c d e f", 0), (2, "a b c d e f", 1), (None, "a b c d e f", 2), (None, "q r s t u v w", 3), (None, "q r s t u v w", 3), (3, "k l m n o p", 4), (3, "z y x w v u t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.stage(spark, df, "")
    assert out.columns == df.columns and sorted((r.doc_id, r.fp) for r in out.collect() if r.doc_id) == [(1, 0), (3, 4), (3, 5)] and out.count() == 4


def test_decontamination_stage_and_proximity(spark, tables):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    folder = tables.documents("clean", [(1, "x y z"), (2, f"x {passage} y"), (3, None), (2, "other text")], benchmark=[(1, passage)])
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n_hit", F.lit(7))
    out = decontaminate.stage(spark, docs, folder)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text, r.n_hit) for r in out.collect() if r.text) == [(1, "x y z", 7), (2, "other text", 7)]
    pairs = spark.createDataFrame([(1, "alpha", "gamma"), (2, "mu", "alpha"), (3, "x", "x")], "query int, first string, second string")
    near = decontaminate.proximity(docs, pairs, 3).collect()
    assert [(r["query"], r.doc_id, r.first_pos, r.second_pos) for r in near] == [(1, 2, 1, 3)]


def test_quality_classifier(spark, tables):
    got = fetched(spark, "op9_pu_quality", "/root/testdata/sf0.01")
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len(got) == 1000 and np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.9
    good, bad = ([r["score"] for r in held if marks[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    odd = tables.documents("unlabelled", ODD)
    assert [r["score"] for r in fetched(spark, "op9_pu_quality", odd)] == [1.0] * len(ODD)
    some = tables.documents("labelled", ODD, labels=[(1, 1, 0), (4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0)])
    assert all(0 <= r["score"] <= 1 for r in fetched(spark, "op9_pu_quality", some))


def test_labels_of_the_held_out_fold_change_nothing(spark, tables):
    rows = documents(spark)
    marks = [(r[0], int(k % 5 > 0), 0) for k, r in enumerate(rows)]
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in marks]
    a = fetched(spark, "op9_pu_quality", tables.documents("marks", rows, labels=marks))
    b = fetched(spark, "op9_pu_quality", tables.documents("flipped", rows, labels=flipped))
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b])


def test_language_model(spark, tables):
    rows = [*ODD, *documents(spark)]
    folder = tables.documents("lm", rows)
    got = fetched(spark, "op10_suffix_tree_lm", folder)
    texts = [(r[0], [*TEN.findall((r[1] or "").translate(LOWER)), None]) for r in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    c = Counter(w for (_, t), h in zip(texts, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    plain = sorted(
        ((d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, t), h in zip(texts, held)), key=repr
    )
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr)
    assert mine == plain
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_states_sum_to_one():
    """Every retained state's probabilities over all words, the unknown one included, sum to one."""
    draw = np.random.default_rng(5)
    ids = draw.choice(6, 4000, p=[0.3, 0.25, 0.2, 0.15, 0.06, 0.04])
    ids[2::4] = (ids[1::4] + 1) % 6
    ids[3::4] = (ids[2::4] * 2 + ids[1::4]) % 6
    common = np.bincount(ids, minlength=6)
    tree = suffix_tree_lm.SuffixTree(np.log10((common + 1) / (len(ids) + 7.0)), common, len(ids))
    first = np.arange(len(ids)) == 0
    tree.first_candidates(1e-3)
    for k in range(3):
        context = tree.contexts(ids, first)[-1]
        use = context >= 0
        pairs, n = np.unique(context[use] * 6 + ids[use], return_counts=True)
        tree.learn(pairs, n, 1e-2)
        if k < 2:
            tree.next_candidates(pairs, n, 1e-3)
    assert tree.levels[0]["kept"].any() and tree.levels[1]["kept"].any()
    rest = 1 / (len(ids) + 7.0)  # the unknown word's share under the root
    for depth, level in enumerate(tree.levels, 1):
        for state in np.flatnonzero(level["kept"]):
            words = np.arange(6)
            total = (10 ** tree.logs_under(depth, np.full(6, state), words)).sum()
            unknown, at, d = 0.0, state, depth
            while d:
                unknown += tree.levels[d - 1]["back"][at] if tree.levels[d - 1]["kept"][at] else 0.0
                at, d = tree.levels[d - 1]["suffix"][at], d - 1
            assert total + rest * 10**unknown == pytest.approx(1)
    assert tree.score(ids, first).sum() > tree.root[ids].sum()
