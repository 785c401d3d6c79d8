"""Mixing, sharding, chat formatting, the pipeline and the queries' SQL."""

import collections
import hashlib
import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup import SPACE, near_groups
from test_filters import benchmark_hits

import corpus_pipeline
from oscilla.llm import catalog, chat, langid, mixing, sharding
from oscilla.llm.store import new_path

FOLDER = "/root/testdata/sf0.001"


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = catalog.queries()[name](spark, FOLDER)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted_rows([tuple(r) for r in df.collect()], df.columns) == sorted_rows(want.fetchall(), want.columns)


# --- mixing


def test_shortages_go_to_siblings_before_ancestors(spark):
    supply = spark.createDataFrame([("a", "x", "s", 10), ("a", "x", "t", 1000), ("b", "x", "s", 1000)], "domain string, lang string, source string, available long")
    got = {(r.domain, r.source): r.share for r in mixing.allowances(supply, F.lit(200).cast("long"), {}, 1).collect()}
    assert got == {("a", "s"): 10, ("a", "t"): 90, ("b", "s"): 100}
    got = {(r.domain, r.source): r.share for r in mixing.allowances(supply.where("source <> 't'"), F.lit(200).cast("long"), {}, 1).collect()}
    assert got == {("a", "s"): 10, ("b", "s"): 190}


def test_weights_budgets_and_remainders(spark):
    supply = spark.createDataFrame([("a", "x", s, 1000) for s in "pqr"], "domain string, lang string, source string, available long")
    got = {r.source: r.share for r in mixing.allowances(supply, F.lit(101).cast("long"), {"source": {"p": 2}}, 1).collect()}
    assert got == {"p": 51, "q": 25, "r": 25} and sum(got.values()) == 101
    assert {r.share for r in mixing.allowances(supply, F.lit(10**9).cast("long"), {}, 3).collect()} == {3000}
    with pytest.raises(ValueError):
        mixing.allowances(supply, F.lit(1), {"source": {"p": 0}}, 1)


def plain_mix(rows, share, seed=17):
    """Tokens taken from one leaf, by repeated passes in hash order."""
    rows = [(i, n) for i, n in rows if n]
    total, out, epoch = sum(n for _, n in rows), [], 0
    while share > 0:
        for i, n in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{epoch}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0])):
            if share < total and share <= 0:
                break
            out.append((i, epoch, min(n, share)))
            share -= min(n, share)
        epoch += 1
    return sorted(out)


@pytest.mark.parametrize("percent, ranges", [(30, 4096), (30, 2), (250, 2), (100, 4096)])
def test_prefixes_of_seeded_epochs(spark, percent, ranges):
    rows = [(i, " ".join(["w"] * (i % 9)), "en", "s") for i in range(50)] + [(77, None, "en", "s"), (78, "", None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, domain int")
    got = mixing.mix(df, domain=F.lit("d"), weights={}, budget_percent=percent, max_epochs=4, range_rows=ranges)
    total = sum(i % 9 for i in range(50))
    want = plain_mix([(i, i % 9) for i in range(50)], total * percent // 100)
    assert sorted((r.doc_id, r.epoch, r.take_tokens) for r in got.collect()) == want
    mixed = mixing.mixed_documents(df, domain=F.lit("d"), weights={}, budget_percent=percent, max_epochs=4, range_rows=ranges)
    assert mixed.columns == df.columns and sum(len(r.text.split()) for r in mixed.collect()) == total * percent // 100
    assert mixing.mix(df.limit(0), domain=F.lit("d"), weights={}).count() == 0


def test_repeated_rows_are_taken_with_their_tokens(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", None, "s")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, domain=F.lit("d"), weights={}, budget_percent=100).collect()
    assert sum(r.take_tokens for r in got) == 5


@pytest.mark.parametrize("percent, epochs", [(50, 1), (40, 4), (100, 1), (230, 3)])
def test_mixed_documents_keep_the_budget_with_null_and_repeated_ids_and_any_column_names(spark, percent, epochs):
    rows = [(None, "a b c d e", "en", "s")] * 7 + [(None, "f g h", None, "s")] * 3 + [(1, "i j k", "en", "t"), (1, "l m n o", "en", "t"), (2, None, "en", "t"), (3, "p", "en", None)]
    extra = ("take_tokens", "n_tokens", "epoch", "row", "domain", "n", "take", "key", "doc")
    df = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in extra)).repartition(3)
    total = sum(len((r[1] or "").split()) for r in rows)
    for ranges in (4096, 1):
        mixed = mixing.mixed_documents(df, domain=F.lit("d"), weights={}, budget_percent=percent, max_epochs=epochs, range_rows=ranges)
        got = mixed.collect()
        assert mixed.columns == df.columns and all(tuple(r)[4:] == tuple(range(len(extra))) for r in got)
        assert sum(len(r.text.split()) for r in got) == min(total * percent // 100, total * epochs)
        assert all(any(r.doc_id == i and (t or "").startswith(r.text) for i, t, *_ in rows) for r in got)
        assert len(got) <= len(rows) * epochs


# --- sharding


def arrivals(spark, ids, size=100):
    return spark.createDataFrame([(i, "x" * size, 1) for i in ids], "doc_id long, text string, key int")


def test_merges_keep_every_row_and_commit_versions(spark):
    store = sharding.ShardStore(spark, new_path(spark, "test"), small=500, target=4000, fan_in=3)
    assert store.version() == 0 and store.manifest().count() == 0
    for k in range(4):
        assert store.append(arrivals(spark, range(100 * k, 100 * k + 10))) == k + 1
    before = store.manifest()
    assert before.count() > 8
    versions = []
    while (v := store.compact()) is not None:
        versions.append(v)
        store.vacuum(0.0)
    assert versions and store.version() == versions[-1] and store.manifest().count() < 5
    rows = store.read()
    assert sorted(r.doc_id for r in rows.collect()) == sorted(100 * k + i for k in range(4) for i in range(10)) and set(rows.columns) == {"doc_id", "text", "key", "_shard", "_batch"}
    assert rows.groupBy("_batch", "_shard").count().join(store.manifest().selectExpr("batch as _batch", "file as _shard", "n"), ["_batch", "_shard"]).where("count <> n").count() == 0
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(), store.version(), store.schema())
    assert store.manifest().count() == store.manifest(store.version()).count()


def test_stores_of_nothing_and_of_nulls(spark):
    store = sharding.ShardStore(spark, new_path(spark, "test"), small=500, target=4000)
    assert store.append(arrivals(spark, []).limit(0)) == 1 and store.manifest().count() == 0 and store.compact() is None
    nulls = spark.createDataFrame([(None, None), (None, "y" * 9000), (3, ""), (3, "")], "doc_id long, text string")
    assert sharding.sharded(nulls, small=500, target=4000).count() == 4
    assert sharding.sharded(nulls.limit(0), small=500, target=4000).count() == 0
    with pytest.raises(ValueError):
        store.append(nulls.withColumn("_shard", F.lit(1)))


def test_of_racing_writers_one_wins_each_version_and_nothing_is_lost(spark):
    store = sharding.ShardStore(spark, new_path(spark, "test"), small=500, target=4000, fan_in=3)
    store.append(arrivals(spark, range(10)))
    state, schema = store.manifest(), store.schema()

    def claim(_):
        try:
            return store.commit(state, 2, schema)
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(claim, range(8)), key=str) == [2] + [None] * 7
        assert sorted(pool.map(lambda k: store.append(arrivals(spark, range(100 * k, 100 * k + 10)), F.lit("same")), range(1, 5))) == [3, 4, 5, 6]
    assert sorted(r.doc_id for r in store.read().collect()) == sorted([*range(10), *(100 * k + i for k in range(1, 5) for i in range(10))])
    while store.compact():
        pass
    assert sorted(r.doc_id for r in store.read().collect()) == sorted([*range(10), *(100 * k + i for k in range(1, 5) for i in range(10))])
    assert store.manifest().groupBy("batch", "shard").count().where("count > 1").count() == 0


def test_a_merge_commits_after_an_append_but_not_after_the_same_merge(spark, monkeypatch):
    stores = [sharding.ShardStore(spark, new_path(spark, "test"), small=500, target=4000, fan_in=3)]
    stores.append(sharding.ShardStore(spark, stores[0].root, small=500, target=4000, fan_in=3))
    for k in range(3):
        stores[0].append(arrivals(spark, range(100 * k, 100 * k + 10)))
    real = sharding.ShardStore._write
    rival = {"do": lambda: stores[1].append(arrivals(spark, range(900, 905)).withColumn("new", F.lit(1.5)))}

    def write(self, rows, tasks):
        done = real(self, rows, tasks)
        if self is stores[0] and rival["do"]:
            act, rival["do"] = rival["do"], None
            act()
        return done

    monkeypatch.setattr(sharding.ShardStore, "_write", write)
    assert stores[0].compact() == 5
    ids = sorted([*(100 * k + i for k in range(3) for i in range(10)), *range(900, 905)])
    rows = stores[1].read()
    assert sorted(r.doc_id for r in rows.collect()) == ids and rows.where("new = 1.5").count() == 5
    for k in range(4, 8):
        stores[1].append(arrivals(spark, range(100 * k, 100 * k + 10)))
    rival["do"] = stores[1].compact
    with pytest.raises(RuntimeError):
        stores[0].compact()
    assert stores[1].read().count() == len(ids) + 40
    with pytest.raises(ValueError):
        stores[0].append(arrivals(spark, [1]).withColumn("key", F.lit("text")))


def test_plans_by_ranges_equal_plans_in_one(spark, monkeypatch):
    store = sharding.ShardStore(spark, new_path(spark, "test"), small=500, target=4000, fan_in=3)
    store.append(arrivals(spark, range(400), 90))
    one = sorted((r.shard, r.into) for r in store.plan().collect())
    monkeypatch.setattr(sharding, "RANGE_SHARDS", 7)
    assert sorted((r.shard, r.into) for r in store.plan().collect()) == one and len(one) > 50


def test_names_of_arrivals_can_have_any_length_and_characters(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_SHARDS", 3)
    names = ["x" * 10_000, "x" * 9_999 + "y", "a/b/../c", "p=q%2F", "tab\t\n", "é" * 3000, "", None, ".", "__HIVE_DEFAULT_PARTITION__"]
    rows = spark.createDataFrame([(i, "t" * (i % 50), names[i % len(names)]) for i in range(200)], "doc_id long, text string, source string")
    out = sharding.sharded(rows, F.col("source"), small=200, target=2000)
    got = out.select("doc_id", "text", "source", "shard", "shard_docs", "shard_bytes").collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == [(i, "t" * (i % 50), names[i % len(names)]) for i in range(200)]
    size = collections.Counter()
    for r in got:
        size[r.shard] += len(r.text) + sharding.ROW_BYTES
    assert all(size[r.shard] == r.shard_bytes for r in got) and max(size.values()) > 1000
    assert any(r.shard.startswith("x" * 9_999) for r in got) and len(size) > 3


def test_sharded_documents_can_have_any_columns(spark):
    rows = arrivals(spark, range(30)).withColumns({c: F.lit(7) for c in ("shard", "_shard", "_batch", "shard_docs", "n", "size")})
    out = sharding.sharded(rows, F.concat(F.lit("a"), F.col("shard").cast("string")), small=500, target=2000)
    assert out.columns == [*rows.columns, "__shard", "_shard_docs", "shard_bytes"]
    assert out.where("shard = 7 and _shard = 7 and n = 7 and __shard like 'a7-%'").count() == 30


# --- chat

HOSTILE = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"a <\\s> b [\INST] [/INST", "[INST:x] y", r"\<s> [\/INST]", "", None, "plain\ntext", "<|im_end|>", "<" * 50 + "s>", "é</s>🎉", r"<\/s>"]
ROLES = ["user", "assistant", "system", None, "odd role]", "~6f", "[INST]", "tool\nx"]


def test_every_text_and_role_comes_back(spark):
    rows = [(c, t, ROLES[(c + t) % len(ROLES)], x, "own") for c in range(8) for t, x in enumerate(HOSTILE)]
    rows += [(9, 1, "user", "tie b", ""), (9, 1, "user", "tie a", ""), (9, None, "user", "first", ""), (None, 0, "user", "n", ""), (9, 1, "user", "tie a", ""), (10, 0, "assistant", "z" * 200000 + "</s>", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    form = chat.formatted(df)
    back = {r.conv_id: [(t.role, t.text, t.ok) for t in r.turns] for r in form.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    for c in range(8):
        assert back[c] == [(ROLES[(c + t) % len(ROLES)] or "", x or "", True) for t, x in enumerate(HOSTILE)]
    assert [t[1] for t in back[9]] == ["first", "tie a", "tie a", "tie b"]
    digest = {r.conv_id: r for r in chat.read_back(form).collect()}
    loss = "".join(x or "" for t, x in enumerate(HOSTILE) if ROLES[t % len(ROLES)] == "assistant")
    assert digest[0].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[0].loss_chars == len(loss) and digest[10].loss_chars == 200004
    assert chat.formatted(df.limit(0)).count() == 0


def test_calm_texts_are_left_alone_and_broken_strings_are_seen(spark):
    df = spark.createDataFrame([(1, 0, "user", r"a \ b < c [d] \\s>"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).first().formatted == r"[INST]a \ b < c [d] \\s>[/INST]<s>fine</s>"
    bad = spark.createDataFrame([("x<s>a</s>",), ("<s>a",), ("<s>a<s>b</s>",), ("<s>a[/INST][INST]b</s>",), ("[INST:user]a[/INST]",), ("[INST:a b]c[/INST]",), ("[INST:x]a</s>",), ("[INST:~6]a[/INST]",)], "formatted string")
    assert all(not all(t.ok for t in r.turns) for r in bad.select(chat.parsed(F.col("formatted")).alias("turns")).collect())


# --- pipeline


def plain_split(children, budget):
    """Tokens of (name, supply, weight) children, the full ones first, the rest by weight."""
    order, share = sorted(children, key=lambda c: (c[1] / c[2], c[0])), {}
    while order and order[0][1] * sum(c[2] for c in order) <= order[0][2] * budget:
        name, supply, _ = order.pop(0)
        share[name], budget = supply, budget - supply
    parts = {name: weight * budget // sum(c[2] for c in order) for name, _, weight in order}
    for k, name in enumerate(sorted(parts)):
        share[name] = min(next(c[1] for c in order if c[0] == name), parts[name] + (k < budget - sum(parts.values())))
    return share


def plain_tree(leaves, budget, level=0):
    """Tokens of each leaf of {(domain, lang, source): tokens}, taken once at most."""
    if level == 3:
        return {leaf: budget for leaf in leaves}
    groups = {}
    for leaf, n in leaves.items():
        groups.setdefault(leaf[level], {})[leaf] = n
    weights = mixing.WEIGHTS[("domain", "lang", "source")[level]]
    shares = plain_split([(name, sum(g.values()), weights.get(name, 1)) for name, g in groups.items()], budget)
    return {leaf: n for name, g in groups.items() for leaf, n in plain_tree(g, shares[name], level + 1).items()}


def plain_domain(source):
    k = int(source[3:]) if source and re.fullmatch("src1?[0-9]", source) else 99
    return "web" if k < 5 else "reference" if k < 10 else "code" if k < 15 else "forum"


def plain_mixture(rows):
    """(id, tokens taken) of the mixture stage; rows are (id, text, lang, source)."""
    leaves = {}
    for i, t, lang, source in rows:
        n = len(SPACE.findall(t or ""))
        if n:
            leaves.setdefault((plain_domain(source), lang or "", source or ""), []).append((i, n))
    sums = {leaf: sum(n for _, n in own) for leaf, own in leaves.items()}
    shares = plain_tree(sums, sum(sums.values()) * 80 // 100)
    return sorted((i, take) for leaf, own in leaves.items() for i, _, take in plain_mix(own, shares[leaf]))


def test_every_pipeline_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    junk = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("12 34 ...").alias("text"), "lang", "source", "n_chars")
    leak = docs.limit(1).select(F.lit(10**6 + 1).cast("long").alias("doc_id"), F.lit(bench[0][1]).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    nulls = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    rows, kept = docs.unionByName(junk).unionByName(leak).unionByName(nulls), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in rows.select("doc_id", "text", "lang", "source").collect()]
        out = stage(spark, rows, FOLDER)
        path = new_path(spark, "test")
        out.write.parquet(path)
        got = spark.read.parquet(path)
        after = sorted(r.doc_id for r in got.select("doc_id").collect())
        if name != "shards":
            assert got.columns == docs.columns
        if name == "language":
            net = langid.train(rows.where(~langid.held_out()))
            said = langid._named(net, pa.array([t for _, t, *_ in before]))
            assert after == sorted(r[0] for r, lang, score in zip(before, *said) if any(c.isalpha() for c in r[1] or "") and score >= langid.LEAST / len(net.langs))
            assert 10**6 not in after and len(after) > 0.98 * docs.count()
        elif name == "near_duplicates":
            assert after == sorted(i for i, _, _, own in near_groups([r[:2] for r in before]) if own) and len(after) < len(before)
        elif name == "decontamination":
            hits = {i: benchmark_hits(t, bench)[:2] for i, t, *_ in before}
            assert after == sorted(i for i, (n, h) in hits.items() if not (h and 20 * h >= n)) and 10**6 + 1 not in after
        elif name == "mixture":
            assert sorted((r.doc_id, len(SPACE.findall(r.text))) for r in got.collect()) == plain_mixture(before)
            text = {r[0]: r[1] for r in before}
            assert all(text[r.doc_id].startswith(r.text) for r in got.collect())
        else:
            assert after == sorted(r[0] for r in before) and got.groupBy("shard").agg(F.count("*").alias("k"), F.min("shard_docs").alias("a"), F.max("shard_docs").alias("b")).where("k <> a or k <> b").count() == 0
        rows, kept[name] = got, len(after)
    assert kept["mixture"] == kept["shards"] > 0
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]


def test_the_network_decides_the_language_stage(spark):
    """Documents half in one language and half in the other come back with about a guess's probability and go; nothing else does."""
    rng = np.random.default_rng(4)
    pure = {lang: ["".join(rng.choice(list(letters), 400)) for _ in range(60)] for lang, letters in (("xx", "abcd "), ("yy", "wxyz "))}
    rows = [(k, t, lang) for lang, texts in pure.items() for k, t in enumerate(texts, 100 * (lang == "yy"))]
    mixed = [(1000 + k, pure["xx"][k] + pure["yy"][k], None) for k in range(10)]
    df = spark.createDataFrame([(*r, "web", 1) for r in rows + mixed + [(2000, "12 ...", "xx"), (2001, None, None)]], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.language(spark, df, FOLDER).collect()}
    assert left == {i for i, *_ in rows}
    assert {r.doc_id for r in langid.drop_unknown(df, least=0.0).collect()} == {i for i, *_ in rows + mixed}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, unlabelled, FOLDER).collect()} == {i for i, *_ in rows + mixed}
    assert corpus_pipeline.language(spark, df.limit(0), FOLDER).count() == 0
