import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagesignal.llm import chat, exact, html, langid, mixing, pieces, sharding, simhash, toxicity
from stagesignal.llm.queries import MODEL_FILE

DOCS = "doc_id long, text string, lang string, source string, _size string, size string"


def docs(spark, rows):
    """rows of (doc_id, text, source), with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, "en", s, "x", "y") for i, t, s in rows], DOCS)


ROWS = [
    (5, "one two  three", "a"), (1, "one two three", "a"), (2, None, None), (3, "", "b"), (9, "one two three", "b"),
    (4, "word " * 30_000, "c"), (7, "\t\none", "c"), (8, "one", "a"), (8, "one", "a"), (6, "é ü  ß", "é"),
    (10, "a b c d e f g h", "a"), (11, "a b c d e f g h", None), (None, "one two three", "a"),
]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["hot"] * 3 + ["b", "c", None]) for i in range(600)]
    rows = [(i, t, s[int(rng.integers(0, 6))]) for i, t, s in rows]
    got = [r.asDict() for r in mixing.mix(docs(spark, rows)).collect()]
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    sums, target, size = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == words(text[r["doc_id"]]) and r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        sums[s] = sums.get(s, 0) + r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(sums[s] - target[s]) <= 60 for s in sums)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    open_ = [s for s in order if target[s] < 2 * size[s] - 1e-6]
    level = {s: target[s] / (3, 1, 2)[order.index(s) % 3] for s in order}
    assert len({round(level[s], 6) for s in open_}) <= 1
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(**r)) for r in got)
    mixed = mixing.mixed_rows(docs(spark, rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}


def test_mixing_prefers_quality(spark):
    rows = [(i, "good plain words here " * 3 if i % 2 else "#### $$$$ 1234 ||||", "a") for i in range(1, 800)] + [(1000, "word " * 9000, "b")]
    got = mixing.mix(docs(spark, rows)).where("doc_id < 1000").collect()
    extra = {True: 0, False: 0}
    for r in got:
        extra[r["doc_id"] % 2 == 1] += r["taken"] > r["size"] * (r["target"] // r["source_size"])
    assert r["target"] == pytest.approx(2 * r["source_size"]) or extra[True] > 3 * extra[False]


def test_edge_rows_everywhere(spark):
    df = docs(spark, ROWS)
    n = len(ROWS)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == n and all(r["size"] == 0 or r["taken"] in (0, r["size"], 2 * r["size"]) for r in mixed)
    assert mixing.mixed_rows(df).columns == df.columns
    assert sharding.shard(df, shards=4).count() == n
    assert simhash.groups(df).count() == n
    assert exact.duplicates(df).count() == n
    assert pieces.encode(df, MODEL_FILE).count() == n
    model = langid.train(["der die und", "the of and"] * 20, ["de", "en"] * 20)
    got = df.select("doc_id", langid.identify(df, model).alias("p")).collect()
    assert len(got) == n and {r["p"]["lang"] for r in got if r["doc_id"] in (2, 3)} == {"und"}
    assert df.select(toxicity.scorer(toxicity.train(["a"], [0]), df)(F.col("text"))).count() == n


def test_empty_tables(spark):
    df = docs(spark, [])
    assert mixing.mix(df).count() == mixing.mixed_rows(df).count() == 0
    assert exact.duplicates(df).count() == exact.unique_rows(df).count() == 0
    assert simhash.groups(df).count() == simhash.distinct_rows(df).count() == 0
    assert sharding.shard(df).count() == pieces.encode(df, MODEL_FILE).count() == 0
    assert langid.accepted_rows(df, langid.fit(df)).count() == 0
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_pairs(chat.neighbour_pairs(turns)).count() == 0
    labelled = df.withColumn("toxic", F.lit(1))
    assert toxicity.fit(labelled).score("x") < 0.01


def test_exact_duplicates(spark):
    got = exact.duplicates(docs(spark, ROWS), capacity=1).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(norm(t), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min(i for i in ids if i is not None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact.unique_rows(docs(spark, ROWS)).collect()
    assert len(kept) == len(groups) and {norm(r["text"]) for r in kept} == set(groups)


def test_directory_splits_and_doubles():
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[:64] = 10
    counts[40_000] = 5
    owner = exact.directory(counts, 100)
    assert len(owner) == 1 << 13 and (np.diff(owner) >= 0).all()
    width = len(counts) // len(owner)
    load = np.bincount(owner, counts.reshape(-1, width).sum(axis=1))
    assert load.max() <= 100 and load.sum() == counts.sum()
    assert len(exact.directory(np.zeros(1 << 16, dtype=np.int64), 1)) == 1


def test_exact_duplicates_with_a_hot_text_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr("stagesignal.llm.common.HOT_ROWS", 5)
    rows = [(f"id{i:04d}", "hot  text" if i % 3 == 0 else f"text {i % 500}", "a") for i in range(900)] + [(None, "hot text", "a")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.duplicates(df, capacity=8).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(" ".join(t.split()), []).append(i)
    wanted = {(i, least, len(ids), i == least) for ids in groups.values() for least in [min(x for x in ids if x)] for i in ids}
    assert got == wanted and exact.unique_rows(df, capacity=8).count() == len(groups)


def brute_print(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=300), st.text("aB \n", max_size=900)), max_size=6))
def test_fingerprints_match_brute_force(texts):
    texts = [t.encode("utf-8", "ignore").decode() if t else t for t in texts]
    assert simhash.fingerprints(texts).tolist() == [brute_print(t) for t in texts]


def test_simhash_components(spark):
    rng = np.random.default_rng(3)
    base = ["w%d" % x for x in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(60):
        w = list(base) if i % 3 else ["v%d" % x for x in rng.integers(0, 5000, 200)]
        if i % 3:
            w[int(rng.integers(0, 400))] = "changed%d" % i
        rows.append((i, " ".join(w), "a"))
    rows += [(100, rows[1][1], "a"), (101, None, "a"), (102, " ", "b"), (103, "x y", "a"), (104, "X\ty", "a")]
    prints = {i: brute_print(t) for i, t, _ in rows}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.groups(docs(spark, rows)).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    assert {r["doc_id"] for r in simhash.distinct_rows(docs(spark, rows)).collect()} == {find(i) for i in prints}


def test_near_dedup_decides_by_id_and_text(spark):
    rng = np.random.default_rng(4)

    def text():
        return " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400))

    a, b, c, d, e = (text() for _ in range(5))
    rows = [
        (1, a, "s"), (2, a + " x", "s"), (2, b, "s"),  # 2 has a near copy of 1 and a text of its own
        (3, c, "s"), (3, c + " x", "s"), (3, c, "s"),  # near copies and a copy under one id
        (None, d, "s"), (None, d + " x", "s"), (None, d, "s"), (None, e, "s"), (9, e + " x", "s"),
        (None, None, "s"), (None, "", "s"),
    ]
    got = sorted((r["doc_id"] or 0, (r["text"] or "").removesuffix(" x")) for r in simhash.distinct_rows(docs(spark, rows)).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (0, d), (9, e), (0, "")])


@pytest.mark.parametrize("gaps", [1, 1 << 22])
def test_tiles_lose_no_link(monkeypatch, gaps):
    monkeypatch.setattr(simhash, "MOST_GAPS", gaps)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    for _ in range(3):
        a[500:1500] = a[rng.integers(0, 1000, 1000)] ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64))
    a = np.unique(a)
    a = a[np.lexsort([a, *simhash._counts(a).T])]

    def roots(edges, names):
        root = {int(x): int(x) for x in names}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            x, y = find(x % 2**64), find(y % 2**64)
            root[max(x, y)] = min(x, y)
        return {x: find(x) for x in root}

    whole = [(int(x), int(y)) for k, x in enumerate(a) for y in a[k + 1 :][np.bitwise_count(a[k + 1 :] ^ x) <= 4]]
    assert roots(whole, a) == roots(simhash.linked(a, None), a)
    half = len(a) // 2
    parts = simhash.linked(a[:half], None) + simhash.linked(a[half:], None) + simhash.linked(a[:half], a[half:])
    assert roots(whole, a) == roots(parts, a)


def test_shards(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "a") for i in range(997)] + [(5, "text 5", "a"), (5000, None, None)]
    got = sharding.shard(docs(spark, rows), shards=16, part_rows=20).collect()
    assert len(got) == len(rows)
    slots, homes = {}, 0
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["law"] == "rows" and r["grown_shard"] is None
        assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes += r["shard"] == r["home_shard"]
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 16 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert homes > len(rows) / 2
    again = sharding.shard(docs(spark, rows).repartition(5), shards=16, part_rows=20)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_ring_moves_few_rows():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(-(2**63), 2**63, 20_000))
    (p, o), (q, u) = sharding.ring(16, 128), sharding.ring(17, 128)
    before, after = o[np.searchsorted(p, keys) % len(p)], u[np.searchsorted(q, keys) % len(q)]
    assert (after[before != after] == 16).all() and (before != after).mean() < 0.1


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out("doc_id", 5, 0)
    model = langid.fit(df.where(~held))
    got = df.where(held).select("lang", langid.identify(df, model).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang"] for r in got]) > 0.95
    assert np.mean([r["p"]["accepted"] for r in got]) > 0.99
    strange = spark.createDataFrame([("съешь же ещё этих мягких французских булок да выпей чаю " * 3,), ("日本語の文章はここにあります" * 9,)], "text string")
    assert not any(r["p"]["accepted"] for r in strange.select(langid.identify(strange, model).alias("p")).collect())


def test_language_rejects_unlearned_latin_languages_and_noise(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out("doc_id", 5, 0)
    model = langid.fit(df.where(~held))
    strange = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı",
        "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "noise": "qwkj zxcvb plmokn wsxedc rfvtgb yhnujm ikolp qazwsx jhgfd mnbvc xzlkj hgfdsa poiuy trewq lkjhg",
    }
    texts = {(k, n): " ".join([t] * 3)[:n] for k, t in strange.items() for n in (40, 80, 300)}
    got = dict(zip(texts, model.predict(pd.Series(list(texts.values())))["accepted"]))
    assert not [k for k, ok in got.items() if ok]
    rows = [" ".join(r["text"].split()[:n]) for r in df.where(held).where("text is not null").collect() for n in (1, 3, 10, 30)]
    assert model.predict(pd.Series([t for t in rows if any(c.isalpha() for c in t)]))["accepted"].mean() > 0.98


def test_language_bounds_need_enough_texts():
    few, many = [0.9] * 10, [0.5] + [0.8] * 1999
    assert langid.bounds([many, few], 0.001).tolist() == pytest.approx([0.8])
    assert langid.bounds([[0.9] * 1000, many], 0.001).tolist() == pytest.approx([0.8, 0.8])
    assert langid.bounds([few, []], 0.001).tolist() == [0.9] and langid.bounds([[]], 0.001).tolist() == [0.0]


def test_toxicity_learns_an_interaction():
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(3000):
        w = ["filler%d" % x for x in rng.integers(0, 300, 30)]
        a, b = (rng.random(2) < 0.5).tolist()
        w += ["insult"] * a + ["groupname"] * b
        texts.append(" ".join(w))
        labels.append(int(a and b))
    model = toxicity.train(texts[:2000], labels[:2000])
    got = np.array([model.score(t) for t in texts[2000:]]) >= 0.5
    assert (got == np.array(labels[2000:], dtype=bool)).mean() > 0.97


def test_toxicity_learns_as_well_from_terms_hashed_in_tasks(spark):
    rows = [(i, f"{'vile insult' if i % 4 == 0 else 'kind word'} number {i % 7} of many", int(i % 4 == 0)) for i in range(200)]
    rows += [(200, None, 0), (201, "", 0), (202, "kind " * 50_000, 0), (203, "vile insult", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert model.score("a vile insult") > 0.7
    assert max(model.score(t) for t in (None, "", "a kind word", "kind " * 60_000)) < 0.7


def test_toxicity_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = df.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = langid.held_out("doc_id", 3, 1)
    model = toxicity.fit(rows.where(~held))
    got = rows.where(held).select("toxic", toxicity.scorer(model, rows)(F.col("text")).alias("s")).collect()
    y, p = np.array([r["toxic"] for r in got]) == 1, np.array([r["s"] for r in got]) >= 0.7
    assert (y & p).sum() / p.sum() > 0.97 and (y & p).sum() / y.sum() >= 0.9  # of 305 labelled toxic rows to learn from


def test_terms_are_words_wherever_they_stand():
    a = toxicity.terms("Some worthless thing, idiot!")
    b = toxicity.terms("x " * 500 + "idiot (WORTHLESS) thing some")
    assert set(a) <= set(b) and len(a) == 6  # four words, and the heads of the longer one


def test_terms_count_beginnings():
    once, often = (toxicity.terms(" ".join("nastyfier nastyfied nastyfull".split()[:n])) for n in (1, 3))
    assert len(once) == 3 and len(often) == 3 + 2 + 2 * 2  # words, two heads, and for each head "2 times" and "3 times"


def test_terms_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefé"), rng.integers(1, 12))) for _ in range(2000)]
    text = " ".join([*words, "z" * 700, "nastyfier nastyfied nastyfull"])
    whole = toxicity.terms(text).tolist()
    for piece in (64, 333, 5000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert toxicity.terms(text).tolist() == whole


def test_toxicity_terms_chosen_in_spark_are_those_chosen_at_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["vile"] * (i % 4 == 0 and rng.random() < 0.9) + ["word%d" % x for x in rng.integers(0, 40, 12)]), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = {r["doc_id"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(toxicity.CHECK)).alias("n")).where(F.col("n") == toxicity.CHECK - 1).collect()}
    learn = [(t, y) for i, t, y in rows if i not in held]
    n = {}
    for t, y in learn:
        for h in toxicity.terms(t).tolist():
            n.setdefault(h, [0, 0])[y] += 1
    p1 = sum(y for _, y in learn)
    p0 = len(learn) - p1
    chi = {h: ((b - (a + b) * p1 / len(learn)) ** 2) / max(1e-9, (a + b) * p1 / len(learn) * p0 / len(learn) * (1 - (a + b) / (len(learn) + 1))) for h, (a, b) in n.items()}
    wanted = sorted(h for h, (a, b) in n.items() if a + b >= toxicity.LEAST_TEXTS and chi[h] > toxicity.LEAST_CHI)
    assert toxicity.fit(df).known.tolist() == wanted and wanted


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=ad>Buy</div><div class="c%d"><article><h1>Head &amp; more</h1><p>First <b>bold</b>
 text.<p>Second&nbsp;one<br>here<script>var t="</p>"</script></p><!-- no --><form><p>Name</p></form></article></div>
<section id="comments"><p>Nice post</p></section><aside>Side</aside><footer>&copy; us</footer></body>"""


def test_html(spark):
    rows = [(1, "http://a.example/1", PAGE % 1), (2, "http://a.example/2", PAGE % 22), (3, "HTTP://A.example:80/3", None), (4, None, "<p>loose &lt;text&gt;"),
            (5, "http://b.example", ""), (6, "http://a.example/odd", "<div><p>only this"), (1, "http://a.example/1", PAGE % 1)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    text = "Head & more\nFirst bold text.\nSecond one here"
    assert sorted(got) == sorted([(i, t, len(t)) for i, t in [(1, text), (1, text), (2, text), (3, ""), (4, "loose <text>"), (5, ""), (6, "only this")]])


@pytest.mark.parametrize("tag", ["article", "main", "article class='post'"])
def test_html_keeps_title_and_lead_beside_a_nested_body(spark, tag):
    end = tag.split()[0]
    body = "".join(f"<p>Paragraph {k} of a long body of text.</p>" for k in range(60))
    page = f"<html><body><nav>Menu</nav><{tag}><h1>Title</h1><p>The lead.</p><div class=body>{body}</div></{end}><footer>Foot</footer></body></html>"
    rows = spark.createDataFrame([(k, "http://a.example/%d" % k, page) for k in range(3)], "page_id long, url string, html string")
    wanted = "\n".join(["Title", "The lead.", *[f"Paragraph {k} of a long body of text." for k in range(60)]])
    got = html.main_text(rows).collect()
    assert [r["text"] for r in got] == [wanted] * 3 and {r["host_path"].split("/")[-1] for r in got} == {"article.post" if "class" in tag else end}


def test_html_agrees_with_the_article(spark):
    import html as lib

    def article(page):
        body = re.search(r"(?s)<article>(.*?)</article>", page)[1].replace("<br>", " ")
        parts = [" ".join(lib.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        return "\n".join(p for p in parts if p)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.main_text(pages).collect()} == wanted


def test_chat(spark):
    rows = [(1, 0, "user", "Hi <|end|>"), (1, 1, "assistant", "A"), (2, 0, "user", "Hi"), (2, 1, "assistant", "B"), (2, 2, "user", "?"), (3, 0, None, None), (5, 0, "assistant", "x"), (4, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = {r["conv_id"]: r["turns"] for r in chat.conversations(turns).collect()}
    pairs = spark.createDataFrame([(1, convs[1], convs[2]), (2, convs[2], convs[2]), (3, convs[3], None), (4, convs[1], convs[1][:1])],
                                  "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in chat.format_pairs(pairs).collect()}
    assert got[1]["prompt"] == "" and got[1]["chosen"].startswith("<|user|>\nHi < |end|><|end|>\n")
    assert got[2]["tie"] and got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prompt_turns"] == 3
    assert got[3]["chosen"] == "<|unknown|>\n<|end|>\n" and got[3]["rejected"] == ""
    assert got[4]["prompt"] == "<|user|>\nHi < |end|><|end|>\n" and got[4]["chosen"] == "<|assistant|>\nA<|end|>\n" and got[4]["rejected"] == ""
    for r in got.values():
        for side in ("chosen", "rejected"):
            assert sum(m["chars"] for m in r[side + "_mask"]) == len(r[side])
    made = {r["pair_id"]: r for r in chat.format_pairs(chat.neighbour_pairs(turns)).collect()}
    assert sorted(made) == [1, 2, 3, 4, 5] and made[4]["tie"]
    plan = chat.format_pairs(chat.neighbour_pairs(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pieces_parity_and_round_trip(spark):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    texts = [None, "", " ", "  a", "a  b ", "\n\ttab", "日本 😀 नमस्ते", "a\0b c", "▁x", " é" * 2000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode(df, MODEL_FILE).collect()}
    assert got[0]["ids"] is None and got[0]["n_tokens"] == 0
    for i, t in enumerate(texts[1:], 1):
        assert got[i]["ids"] == other.encode(t) and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["parity"]
        assert got[i]["round_trip"] and (other.decode(got[i]["ids"]) == t or "▁" in t or t.startswith(" "))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_pieces_property(text):
    text = text.encode("utf-8", "ignore").decode()
    coder = _coder()
    ids, same = coder.encode([text])
    assert same[0] and np.frombuffer(ids[0], dtype=np.int32).tolist() == coder.other.encode(text) and coder.returns(text, np.frombuffer(ids[0], dtype=np.int32).tolist())


_CODER = []


def _coder():
    if not _CODER:
        _CODER.append(pieces.Coder(open(MODEL_FILE, "rb").read()))
    return _CODER[0]
