"""The ten operators against brute force, round trips, held-out accuracy and DuckDB; odd rows and empty tables for each."""

import collections
import math
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import decontamination, exact_dedup, html_extract, lm_scoring, near_dedup, packing, queries, resampling, sharding, suffix_dedup, token_counts, toxicity
from ledgerlark.llm.common import WordHashes

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (4, "x"), (4, "y"), (None, "a b c d e f g"), (None, None), (7, "héllo wörld 你好 🎉 " * 30), (8, "word " * 60_000), (9, "<|endoftext|> don't 'S")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables of odd rows, with columns whose names clash with those that operators make."""
    home = str(tmp_path_factory.mktemp("odd"))
    docs = documents(spark, ODD).withColumns({c: F.lit("clash") for c in ("node", "key", "keys", "codes", "digest", "keep_id", "size", "shard", "score", "class_id", "item_id", "band", "uid")})
    docs.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, "x"), (2, None), (3, ""), (None, "a b c d e f g"), (3, "word word word word word word word")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>a &amp; b"), (3, "u", "<div>" * 3000 + "deep"), (3, "u", "< > <b <!-- <p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (None, None, None, None)], TURNS).write.parquet(f"{home}/conversations.parquet")
    return home


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("conversations", TURNS)):
        spark.createDataFrame([], schema).write.parquet(f"{home}/{name}.parquet")
    return home


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd_dir, name):
    found = queries.QUERIES[name](spark, odd_dir).collect()
    if name == "op2_decontaminate":
        assert {(r.doc_id, r.item_id) for r in found} >= {(4, 1), (None, None), (8, 3)}
    elif name == "op4_html_extract":
        assert len(found) == 5
    elif name in ("op12_repair", "op13_chat_format"):
        # By value in test_conversations.py; here one with an id, one without, and the one that formatting adds.
        assert len(found) == (2 if name == "op12_repair" else 3)
    elif name != "op9_pack":
        assert len(found) == len(ODD)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    # Formatting adds a conversation of its own.
    assert queries.QUERIES[name](spark, empty_dir).count() == (name == "op13_chat_format")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts_of(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in table(spark, "documents", sf).collect()}


def test_op1_brute_force(spark):
    texts = texts_of(spark)
    names = list(texts)
    counts = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := re.findall(r"\w+", t.lower())) else None for t in texts.values()]
    df = collections.Counter(s for c in counts if c for s in c)
    weigh = lambda c: {s: k * (1 + min(1.0, max(0.0, math.log(len(texts) / df[s]) / 4))) for s, k in c.items()}
    vectors = [weigh(c) if c else {} for c in counts]
    totals = [sum(v.values()) for v in vectors]
    first = list(range(len(names)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    held = collections.defaultdict(list)
    for i, v in enumerate(vectors):
        for s in v:
            held[s].append(i)
    met = {(i, j) for s in held.values() if len(s) < 200 for k, i in enumerate(s) for j in s[k + 1 :]}
    borderline = set()
    for i, j in met:
        both = sum(min(x, vectors[j][s]) for s, x in vectors[i].items() if s in vectors[j])
        similarity = both / (totals[i] + totals[j] - both)
        if similarity >= 0.8:
            first[max(root(i), root(j))] = min(root(i), root(j))
        if abs(similarity - 0.8) < 0.01:
            borderline |= {names[i], names[j]}
    for t in set(texts.values()):
        same = [i for i, n in enumerate(names) if texts[n] == t]
        for i in same[1:]:
            first[max(root(i), root(same[0]))] = min(root(i), root(same[0]))
    expected = {n: names[root(i)] for i, n in enumerate(names)}
    found = {r.doc_id: r.class_id for r in near_dedup.op1_minhash_near_dedup(spark, SF).collect()}
    classes = lambda m: {tuple(sorted(k for k in m if m[k] == c)) for c in set(m.values())}
    wrong = {n for c in classes(found) ^ classes(expected) for n in c} - borderline
    assert len(classes(expected)) < len(names)
    assert len(wrong) <= 0.01 * len(names)


def test_op1_tiles_join_a_bucket_of_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(200, rng.integers(0, 9), replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    sketch, n = near_dedup.document_frequencies(documents(spark, rows))
    vectors = {}
    for i, t in rows:
        _, h, count = near_dedup.shingles([t], WordHashes())
        vectors[i] = h, count * near_dedup.inverse_frequency(h, sketch, n)
    links = [(i, j) for i in vectors for j in vectors if i < j and near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8]
    monkeypatch.setattr(near_dedup, "TILE", 32)
    found = {r["_id"]: r["class_id"] for r in near_dedup.near_classes(documents(spark, rows)).collect()}
    assert len(links) > 100
    assert np.mean([found[i] == found[j] for i, j in links]) > 0.99


def test_op2_brute_force(spark):
    texts, items = texts_of(spark, SMALL), [(r.item_id, decontamination.words_of(r.text)) for r in table(spark, "benchmark", SMALL).collect()]
    expected = set()
    for doc, t in texts.items():
        words = decontamination.words_of(t)
        expected |= {(doc, i) for i, w in items if w and decontamination.best_match(w, words)[0] <= decontamination.edits(len(w))}
    found = {(r.doc_id, r.item_id) for r in decontamination.op2_decontaminate(spark, SMALL).collect()}
    assert found <= expected
    assert len(found) >= 0.9 * len(expected) > 0


def edited(rng, words, kind, where):
    """``words`` with as many edits of one kind as an item of that size allows, spread at random or in one place."""
    most, n = decontamination.edits(len(words)), len(words)
    at = rng.choice(n, most, replace=False) if where == "random" else {"start": 0, "middle": (n - most) // 2, "end": n - most}[where] + np.arange(most)
    out, at = [], set(at.tolist())
    for i, word in enumerate(words):
        if i not in at or kind == "insert":
            out.append(word)
        if i in at and kind != "delete":
            out.append(f"new{i}")
    return out


def test_op2_recall_of_each_kind_of_edit(spark):
    rng = np.random.default_rng(5)
    items, rows, kinds = [], [], {}
    for kind in ("substitute", "delete", "insert"):
        for where in ("random", "start", "middle", "end"):
            for size in (5, 6, 7, 8, 9, 10, 12, 16, 30, 60, 120, 500, 1000):
                for _ in range(10 if size < 500 else 4):
                    words = [f"q{x}" for x in rng.integers(3000, size=size)]
                    kinds[len(items)] = kind, where, size
                    rows.append((len(items), "lead in words " + " ".join(edited(rng, words, kind, where)) + " trailing words"))
                    items.append((len(items), " ".join(words)))
    verbatim = [(10_000 + i, "some text before " + t + " and after") for i, t in items]
    found = {(r["_id"], r["item_id"]) for r in decontamination.find_leaks(documents(spark, rows + verbatim), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(10_000 + i, i) for i, _ in items} <= found <= {(k, i) for i, _ in items for k in (i, 10_000 + i)}
    for part in (0, 1, 2):
        for value in {k[part] for k in kinds.values()}:
            own = [i for i, k in kinds.items() if k[part] == value]
            assert np.mean([(i, i) in found for i in own]) >= 0.9, value
    for kind, where in {k[:2] for k in kinds.values()}:
        own = [i for i, k in kinds.items() if k[:2] == (kind, where)]
        assert np.mean([(i, i) in found for i in own]) >= 0.9, (kind, where)
    # One edit leaves a pair of words, which surely has a key.
    for kind in ("substitute", "delete", "insert"):
        for size in range(5, 10):
            own = [i for i, k in kinds.items() if (k[0], k[2]) == (kind, size)]
            assert np.mean([(i, i) in found for i in own]) >= 0.95, (kind, size)


def test_op2_maps_grow_with_the_items():
    assert decontamination.bits_for(10) == 20 and decontamination.bits_for(1 << 40) == 30
    assert all(16 * n <= 1 << decontamination.bits_for(n) for n in (1, 70_000, 1 << 20, 1 << 25))


def test_op2_says_where_and_how_far(spark):
    item = [f"w{i}" for i in range(20)]
    text = ["before"] * 7 + item[:5] + ["other"] + item[6:] + ["after"] * 9
    row = decontamination.find_leaks(documents(spark, [(1, " ".join(text))]), spark.createDataFrame([(4, " ".join(item))], "item_id long, text string")).first()
    assert (row["_id"], row["item_id"], row["n"], row["edits"], row["begin"]) == (1, 4, 20, 1, 7)


def test_op3_equals_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(7)
    alphabet = list("ab Z9' \n\t\r.,!-_sStTrReEvVmMlLdD") + ["é", "你", "🎉", " ", " ", "½", "ǅ", "̀", "'re", "<|endoftext|>", "  ", "\x1c"]
    rows = [*texts_of(spark).items()][:300] + [(10_000 + i, "".join(rng.choice(alphabet, rng.integers(0, 400)))) for i in range(600)]
    found = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(documents(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert found == {i: (len(whole.encode(t, add_special_tokens=False).ids), len(t.encode())) for i, t in rows}


@pytest.mark.parametrize("held", [token_counts.STATES_HELD, 3])
def test_op3_merge_transducer_equals_the_library_on_any_piece(monkeypatch, held):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "STATES_HELD", held)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, merges, rng = Tokenizer.from_file(path), token_counts.MergeTransducer(path), np.random.default_rng(9)
    pieces = ["a" * 300, "ing" * 40, "thethethe", "é" * 30, "你好" * 20] + ["".join(rng.choice(list(alphabet), rng.integers(1, 40))) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "aé你🎉", "ab") for _ in range(300)]
    split = [p for p in pieces if len(library.pre_tokenizer.pre_tokenize_str(p)) == 1]
    assert len(split) > 700
    assert [merges.count(p.encode()) for p in split] == [len(library.encode(p, add_special_tokens=False).ids) for p in split]


def test_op4_keeps_the_article(spark, tmp_path):
    prose = "The committee met on Tuesday to discuss the harbour plan, and most members agreed that it should go ahead."
    page = f"""<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
      <article><h1>Harbour plan</h1><p>{prose}</p><p>{prose} R&amp;D   costs rise.</p></article><script>var x = 1</script>
      <form><input><label>Subscribe</label></form><footer><a href=/c>Imprint</a> Copyright 2024</footer></body></html>"""
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = html_extract.op4_html_extract(spark, str(tmp_path)).first()
    assert row.text == f"Harbour plan {prose} {prose} R&D costs rise."
    assert row.n_chars == len(row.text)


def test_op4_cuts_equal_the_least_of_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        net = [float(x) for x in np.round(rng.normal(0, 2, n), 3)]
        ties = {(i, j): float(np.round(rng.random() * 2, 3)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda kept: sum(-x for x, k in zip(net, kept, strict=True) if k and x < 0) + sum(x for x, k in zip(net, kept, strict=True) if not k and x > 0) + sum(w for (i, j), w in ties.items() if kept[i] != kept[j])  # noqa: B023, E731
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(net, ties)) == pytest.approx(least, abs=1e-6)


def test_op4_text_of_all_pages(spark):
    """In these pages the article's element holds the main text and nothing else."""
    import html

    wrong = 0
    pages = {r.page_id: r.html for r in table(spark, "pages").collect()}
    for r in html_extract.op4_html_extract(spark, SF).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id]).group(1)
        wrong += r.text != " ".join(html.unescape(re.sub(r"<(?:/?(?:p|h1|br)\b)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
    assert wrong <= 0.02 * len(pages)


def test_op4_learns_what_class_names_mean():
    """Blocks under an unknown name, met beside clear boilerplate, are told from the article's."""
    prose = "The committee met on Tuesday to discuss the harbour plan, and most members agreed that it should go ahead."
    clear, named = html_extract.text_features(prose, 0), sorted(html_extract.name_words([("class", "zqx-box")]))
    model = html_extract.fit(np.array([clear] * 200), [[]] * 100 + [named] * 100, np.array([1.0] * 100 + [0.0] * 100))
    assert model.odds(prose, 0, frozenset()) > 1 and model.odds(prose, 0, frozenset(named)) < -1
    assert html_extract.fit(np.zeros((0, len(html_extract.PRIOR))), [], np.zeros(0)).weights[:4].tolist() == list(html_extract.PRIOR[:4])


def test_op5_balance_and_slots(spark):
    rows = sharding.op5_shard(spark, SF).collect()
    texts = table(spark, "documents").collect()
    assert len(rows) == len(texts)
    sizes, slots, by_text = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    own = {r.doc_id: r.text or "" for r in texts}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(own[r.doc_id].encode()) + 8, zlib.crc32(own[r.doc_id].encode()))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_text[own[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) < 0.01 * max(sizes.values())


def test_op5_differencing_of_a_tree_of_buckets(spark):
    rng = np.random.default_rng(1)
    groups = spark.createDataFrame([(i.to_bytes(8, "big"), int(s)) for i, s in enumerate(rng.pareto(1.5, 3000) * 100 + 8)], "key binary, size long")
    shards = sharding.assign_groups(groups, 7, bucket=100, fan=4).join(groups, "key").groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(shards) == 7 and max(r.s for r in shards) - min(r.s for r in shards) <= 0.02 * max(r.s for r in shards)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(queries.ORACLES[name])
    columns = sorted(expected.columns)
    rows = queries.QUERIES[name](spark, SF).select(columns).collect()
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(map(repr, r)) for r in rows) == sorted(tuple(repr(r[i]) for i in at) for r in expected.fetchall())


def test_op6_index_persists_between_batches(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_two_batches", 4)
    first = exact_dedup.exact_dedup(documents(spark, [(5, "a  b"), (3, "a b"), (9, "c")]), index).collect()
    second = exact_dedup.exact_dedup(documents(spark, [(1, "a\tb"), (2, "d")]), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in first} == {(5, 3, False), (3, 3, True), (9, 9, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in second} == {(1, 3, False), (2, 2, True)}


def plain_risk(weights, positives, unlabelled, prior):
    """The two parts of the positive-unlabelled risk by loops over rows: positive part, negative part."""
    margin = lambda row: weights[-1] + sum(weights[f] for f in row)
    loss = lambda x: math.log1p(math.exp(-x))
    mean = lambda rows, sign: sum(loss(sign * margin(r)) for r in rows) / len(rows)
    return prior * mean(positives, 1), mean(unlabelled, -1) - prior * mean(positives, -1)


def test_op7_risk_and_steps_equal_plain_ones():
    rng, seen = np.random.default_rng(15), set()
    for prior in (0.05, 0.3, 0.9):
        for shift in (-3.0, 0.0, 4.0):
            k = 6
            rows = lambda n: [np.flatnonzero(rng.random(k) < 0.4) for _ in range(n)]  # noqa: B023, E731
            positives, unlabelled, weights = rows(7), rows(11), rng.normal(0, 1, k + 1) + np.array([shift] * k + [0.0])
            risk, step = toxicity.risk_and_step(weights, toxicity.flat(positives), toxicity.flat(unlabelled), prior)
            good, bad = plain_risk(weights, positives, unlabelled, prior)
            assert risk == pytest.approx(good + max(0.0, bad))
            # Where the negative part is below zero, the step climbs out of it.
            target = (lambda w: sum(plain_risk(w, positives, unlabelled, prior))) if bad >= 0 else (lambda w: -plain_risk(w, positives, unlabelled, prior)[1])  # noqa: B023
            seen.add(bad >= 0)
            for i in range(k + 1):
                d = np.zeros(k + 1)
                d[i] = 1e-6
                assert step[i] == pytest.approx((target(weights + d) - target(weights - d)) / 2e-6, abs=1e-5)
    assert seen == {True, False}


def test_op7_learns_the_prior_from_labels_and_separates():
    rng = np.random.default_rng(16)
    toxic = lambda: np.array([0, *np.flatnonzero(rng.random(5) < 0.3) + 1])
    clean = lambda: np.flatnonzero(rng.random(5) < 0.3) + 1
    weights = toxicity.fit([toxic() for _ in range(80)], [toxic() for _ in range(40)] + [clean() for _ in range(360)], 6, 0.1)
    assert weights[0] + weights[-1] > 0 > weights[-1]


def test_op7_ranks_held_out_labels(spark):
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1")
    labels = table(spark, "labels", "/root/testdata/sf0.1").select("doc_id", "toxic")
    held = rows.where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    hot, cold = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    auc = np.mean([(a > b) + (a == b) / 2 for a in hot for b in cold])
    assert auc > 0.95
    assert np.mean([a >= 0.5 for a in hot]) > 0.85 and np.mean([b >= 0.5 for b in cold]) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BYTES, 500, 0])
def test_op8_brute_force(spark, hot):
    rng = np.random.default_rng(11)
    pool = [bytes(rng.choice(list(b"abcdefgh "), 150)).decode() for _ in range(6)]
    rows = []
    for i in range(40):
        parts = ["".join(rng.choice(list("xyz é"), rng.integers(0, 120))) for _ in range(3)]
        parts.insert(1, pool[rng.integers(6)][: rng.integers(90, 151)])
        rows.append((i, "".join(parts)))
    rows += [(50, "ab" * 200), (51, "ab" * 60), (52, None), (53, "z" * 99), (54, "z" * 100), (55, "z" * 101)]
    seen, expected = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(data[at : at + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        expected[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha256(kept).hexdigest())
    docs = documents(spark, rows)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, hot_bytes=hot).collect()}
    assert found == expected


def test_op9_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of(spark)
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op9_pack(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    assert set(pieces) == set(texts)
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
    assert total > 0.97 * 2048 * len(sequences)


def test_op9_words_equal_the_library():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(8)
    whole, own = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["".join(rng.choice(list("abcXYZ éÉñ你好🎉'.,!?12\u0301 \n\tΣİßǅ"), rng.integers(0, 80))) for _ in range(400)] + ["don't we'll <|endoftext|> x", "o\u0301 O\u0301"]
    assert all(own.encode(t).tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts)


def every_point(step=1 << 14):
    """Blocks of code points, unassigned ones too, each in the context of a word, a number, spaces and marks."""
    points = [*range(1, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200), *range(0xF0000, 0xF0010)]
    for begin in range(0, len(points), step):
        yield [around.replace("{}", chr(p)) for p in points[begin : begin + step] for around in ("x{} 9{} ", "{}'s!{}", "a{}\u0301z")]


def test_op3_equals_the_library_on_every_code_point():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_counts.Transducer(path, token_counts.character_classes(path))
    for texts in every_point():
        assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op9_equals_the_library_on_every_code_point():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordIds(path)
    for texts in every_point():
        assert [own.encode(t)[:-1].tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op9_three_limits_hold_at_once(spark):
    """Conversations of which only answers bear loss: the loss limit binds in some sequences, the token or segment limit in others."""
    rng, rows = np.random.default_rng(12), []
    for conv in range(150):
        heavy = conv % 2 == 0
        for turn in range(int(rng.integers(1, 7))):
            role = "assistant" if turn % 2 else "user"
            rows.append((conv, turn, role, " ".join(f"w{x}" for x in rng.integers(99, size=rng.integers(0, 160 if heavy == (role == "assistant") else 12)))))
    rows += [(None, None, None, None), (7, None, "assistant", "late"), (900, 0, "assistant", "many " * 9000), (901, 100, "user", "x")]
    path, limit, most = public_tokenizers.path("word_bpe_49k.json"), 700, 9
    words = packing.WordIds(path)
    found = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), path, loss=limit, segments=most).collect()
    sequences, ids, loss = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in found:
        sequences[r.sequence_id].append(r)
        ids[r.doc_id] += r.length
        loss[r.doc_id] += r.loss_tokens
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 2048 and len(own) <= most and sum(r.loss_tokens for r in own) <= limit
    assert {sum(r.loss_tokens for r in own) == limit for own in sequences.values()} == {True, False}
    assert any(len(own) == most for own in sequences.values())
    expected, bearing = collections.Counter(), collections.Counter()
    for conv, _, role, text in rows:
        n = len(words.encode(text or ""))
        expected[conv] += n
        bearing[conv] += n * (role == "assistant")
    assert (ids, +loss) == (expected, +bearing)


def test_op10_base_is_exact_and_the_model_beats_it(spark):
    texts = texts_of(spark)
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = collections.Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = lm_scoring.op10_lm_score(spark, SF).collect()
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert all(r.score < 0 for r in rows)
    # The tree needs some megabytes of text to overtake word frequencies on texts that it has not seen.
    larger = lm_scoring.op10_lm_score(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("share")).first()
    assert larger.model > 0.98 * larger.base and larger.share > 0.75


def weighted_by_hand(learning, texts):
    """Context-tree weighting over bytes with a dict of all nodes, as plain loops."""
    depth, end = lm_scoring.DEPTH, lm_scoring.END
    coded = lambda t: [(end * depth + (t or "").encode().lower() + end)[i - depth : i + 1] for i in range(depth, len((t or "").encode()) + depth + 1)]
    choices = lambda g: [((g[-1] + 256) >> (8 - i), (g[-1] >> (7 - i)) & 1) for i in range(8)]
    counts = collections.defaultdict(lambda: [0, 0])
    for t in learning:
        for g in coded(t):
            for prefix, bit in choices(g):
                for d in range(depth + 1):
                    counts[g[depth - d : depth], prefix][bit] += 1
    weight, splits = {}, collections.defaultdict(float)
    for (context, prefix), (a, b) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        total = own if len(context) == depth else float(np.logaddexp(own, splits[context, prefix])) - math.log(2)
        weight[context, prefix] = 1.0 if len(context) == depth else math.exp(own - math.log(2) - total)
        if context:
            splits[context[1:], prefix] += total
    def log10(g):
        out = 0.0
        for prefix, bit in choices(g):
            p, met = 0.5, False
            for d in range(depth, -1, -1):
                node = (g[depth - d : depth], prefix)
                if node in counts:
                    w = weight[node] if met else 1.0
                    p, met = w * (counts[node][1] + 0.5) / (sum(counts[node]) + 1) + (1 - w) * p, True
            out += math.log10(p if bit else 1 - p)
        return out
    return [sum(map(log10, coded(t))) for t in texts]


@pytest.mark.parametrize("cached", [1 << 21, 300, 0])
def test_op10_scores_with_every_node(spark, monkeypatch, cached):
    monkeypatch.setattr(lm_scoring, "CACHED", cached, raising=False)
    texts = [r.text for r in table(spark, "documents", SMALL).where("length(text) < 900").orderBy("doc_id").limit(30).collect()]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "né 🎉 unmet zqzq"), (None, "né"), (903, texts[0])]
    held = {r.doc_id: r.held_out for r in documents(spark, rows).select("doc_id", (lm_scoring.fold() == 1).alias("held_out")).collect()}
    expected = collections.Counter(zip((i for i, _ in rows), (round(x, 5) for x in weighted_by_hand([t for i, t in rows if not held[i]], [t for _, t in rows])), strict=True))
    assert any(held.values())
    assert collections.Counter((r.doc_id, round(r.score, 5)) for r in lm_scoring.score_documents(documents(spark, rows)).collect()) == expected


def test_pipeline(spark):
    docs, kept = table(spark, "documents", SMALL), {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, SMALL)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id for r in out.collect()}
        current = out
    sizes = [docs.count(), *map(len, kept.values())]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.3 * sizes[0]
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="session")
def odd_rows(spark, odd_dir):
    return spark.read.parquet(f"{odd_dir}/documents.parquet")


EVERY = collections.Counter(ODD)


def test_stage_exact_dedup_on_odd_rows(spark, odd_dir, odd_rows):
    out = corpus_pipeline.exact_stage(spark, odd_rows, odd_dir)
    # Null and empty are one text, of which the least id stays; of two equal rows one stays.
    assert rows_of(out) == EVERY - collections.Counter([(2, ""), (None, None), (4, "x")])
    assert out.columns == odd_rows.columns


def test_stage_near_dedup_on_odd_rows(spark, odd_dir, odd_rows):
    out = corpus_pipeline.near_stage(spark, odd_rows, odd_dir)
    assert rows_of(out) == EVERY - collections.Counter([(2, ""), (None, None)])
    assert out.columns == odd_rows.columns


def test_stage_decontamination_on_odd_rows(spark, odd_dir, odd_rows):
    out = corpus_pipeline.decontamination_stage(spark, odd_rows, odd_dir)
    # Items "x", "a b c d e f g" and seven times "word" are held; null and empty items match nothing.
    assert rows_of(out) == EVERY - collections.Counter([(4, "x"), (4, "x"), (None, "a b c d e f g"), (8, "word " * 60_000)])
    assert out.columns == odd_rows.columns


def test_stage_toxicity_on_odd_rows(spark, odd_dir, odd_rows):
    out = corpus_pipeline.toxicity_stage(spark, odd_rows, odd_dir)
    assert not rows_of(out) - EVERY and out.columns == odd_rows.columns
    assert rows_of(out)[4, "x"] in (0, 2)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{odd_dir}/unlabelled/labels.parquet")
    assert rows_of(corpus_pipeline.toxicity_stage(spark, odd_rows, f"{odd_dir}/unlabelled")) == EVERY


def test_stage_packing_on_odd_rows(spark, odd_dir, odd_rows):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for i, t in ODD:
        expected[i] += len(words.encode(t or ""))
    found = collections.Counter()
    for r in corpus_pipeline.packing_stage(spark, odd_rows, odd_dir).collect():
        found[r.doc_id] += r.length
    assert found == expected


def test_op6_values_of_odd_rows(spark, odd_dir):
    found = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.op6_exact_dedup(spark, odd_dir).collect())
    expected = [(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 1, True), (4, 4, 2, True), (4, 4, 2, False), (4, 4, 1, True), (None, None, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert found == collections.Counter(expected)


def test_op1_values_of_odd_rows(spark, odd_dir):
    found = collections.Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.op1_minhash_near_dedup(spark, odd_dir).collect())
    expected = [(1, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 1), (4, 4, 2), (4, 4, 2), (4, 4, 1), (None, None, 1), (7, 7, 1), (8, 8, 1), (9, 9, 1)]
    assert found == collections.Counter(expected)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, odd_dir, empty_dir, which):
    found = {r.doc_id for r in corpus_pipeline.run(spark, odd_dir if which == "odd" else empty_dir).collect()}
    assert found <= ({1, 3, 4, 7, 9} if which == "odd" else set())
    assert which == "empty" or found >= {3, 9} - {None}


def drawn_by_hand(rows, items, percent=10, least_words=20):
    """doc_id, n_features, weight, score and rank of each row, in plain loops."""
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    buckets = lambda texts: collections.Counter(zlib.crc32(w.encode()) % 10000 for t in texts for w in words(t))
    s, t = buckets(r[1] for r in rows), buckets(items)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for s_all, t_all in [(s.total(), t.total())] for b in s}
    out = []
    for i, text in rows:
        own = words(text)
        weight = sum(gain[zlib.crc32(w.encode()) % 10000] for w in own) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(can[: len(can) * percent // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def test_op11_equals_plain_loops(spark, odd_dir, tmp_path):
    rows = lambda home: [(r.doc_id, r.text) for r in table(spark, "documents", home).collect()]
    for home in (odd_dir, SMALL):
        items = [r.text for r in table(spark, "benchmark", home).collect()]
        assert sorted(map(tuple, resampling.op11_resample(spark, home).collect()), key=repr) == drawn_by_hand(rows(home), items)


def test_op11_ties_and_repeated_rows(spark, monkeypatch):
    """Rows repeated with id and text have ranks of their own; of one score the smaller id is first, and frequent words are looked up as the others are."""
    rng = np.random.default_rng(2)
    rows = [(i % 40 if i % 3 else None, " ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 500) + f" {'Long' * 30}") for i in range(200)]
    rows += [rows[7]] * 60 + [(i, rows[11][1]) for i in range(1000, 1030)]
    items = [(1, " ".join(f"w{x}" for x in range(30)))]
    docs, target = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((r[0] or -1, r[3], r[4] or 0) for r in drawn_by_hand(rows, [t for _, t in items], 30))
    for frequent in (1, 100_000):
        monkeypatch.setattr(resampling, "FREQUENT", frequent)
        found = resampling.resample(docs, target, percent=30).collect()
        ranks = sorted(r["rank"] for r in found if r["rank"])
        assert ranks == list(range(1, len(rows) * 30 // 100 + 1))
        assert sorted((r["_id"] or -1, r["score"]) for r in found) == [e[:2] for e in expected]
        # Null ids of one score stand in any order, so ranks are compared by score.
        assert sorted((r["rank"], r["score"]) for r in found if r["rank"]) == sorted((e[2], e[1]) for e in expected if e[2])
    kept = resampling.keep_drawn(docs, target, percent=30)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_op11_longer_features(spark):
    found = resampling.weights(documents(spark, [(1, "A b a B a"), (2, "b"), (3, None)]), spark.createDataFrame([(1, "a b")], "item_id long, text string"), longest=2).collect()
    assert {r["_id"]: (r["words"], r["features"], r["copies"]) for r in found} == {1: (5, 9, 1), 2: (1, 1, 1), 3: (0, 0, 1)}
