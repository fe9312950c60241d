"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from testpulse.llm import (
    bpe, chat, linededup, neighbours, packing, quality, sharding, simhash, toxicity, wrappers,
)
from testpulse.llm.components import components
from testpulse.llm.numbering import numbered

LONG = " ".join(f"word{i % 977} the of and" for i in range(30_000))
TEXTS = [
    (1, "The cat and the dog ran to the house of the man. It was late and they were tired. They slept."),
    (1, "The cat and the dog ran to the house of the man. It was late and they were tired. They slept."),
    (2, None), (3, ""), (None, "A text of the author that has no id and is not long at all, to be sure."),
    (4, LONG), (5, LONG), (6, " \n\t "),
]
RESULT_NAMES = ["_m", "_doc", "n_words", "kept", "shard", "slot", "score", "_fp", "_id", "word", "ids", "length", "line"]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows with columns named like results."""
    made = spark.createDataFrame(TEXTS, SCHEMA)
    return made.select("*", *[F.lit(None).cast("string").alias(c) for c in RESULT_NAMES])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (4, None, 0), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


def test_quality(docs, none):
    found = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    assert found[(2, 0)].base_failed and not found[(3, 0)].kept and not found[(6, 0)].kept
    assert found[(4, 120_000)].n_repeat_words == 120_000
    assert quality.judge(docs).count() == len(TEXTS) and quality.judge(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}
    assert kept.count() == 3


def test_quality_repeats(spark):
    def plain(text):
        w = text.split()
        places = {}
        for i in range(len(w) - 4):
            places.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
        return len(covered)

    draw = random.Random(3)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    found = quality.judge(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert all(r.n_repeat_words == plain(texts[r.doc_id]) for r in found)


def test_toxicity(docs, none, labels):
    scored = toxicity.score(docs, labels).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_ordinary(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_separates(spark):
    draw = random.Random(5)
    plain = ["house", "river", "green", "walk", "table", "winter", "music", "paper", "window", "garden"]
    rows, marks = [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            words[draw.randrange(40)] = "vilex" + draw.choice(["o", "ant", "ity", "ing", "ous"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 5 == 0)))
    found = toxicity.score(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int"))
    held = found.filter("held_out").collect()
    assert held and all(r.predicted == int(r._id % 5 == 0) for r in held)


def test_line_dedup(spark, docs, none):
    assert linededup.repeated_runs(none).count() == 0
    assert linededup.remove_repeats(none).count() == 0
    left = linededup.remove_repeats(docs, min_words=5)
    assert left.columns == docs.columns
    rows = left.collect()
    # Both rows of one id and text stay; the second long text is a repeat as a whole.
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 2, 3, 4, 6]
    assert {r.text for r in rows if r.doc_id == 4} == {LONG}


def test_line_dedup_runs_inside(spark):
    run = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen to twenty is next. "
    rows = [(1, run + "End of the first."), (2, "Start of it.\n" + run + "Other end."), (3, "Alone. " * 9),
            (None, run)]
    found = {r.doc_id: r.text for r in linededup.remove_repeats(
        spark.createDataFrame(rows, SCHEMA), min_words=10).collect()}
    assert found[1] == "End of the first." and found[2] == "Start of it.\nOther end."
    assert found[None] == run  # no id comes first
    assert found[3] == "Alone. " * 9 or found[3].count("Alone.") < 9


def sentence(name, n):
    return " ".join(f"{name}{i}" for i in range(n)) + ". "


def runs_of(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r._id: (r.first_line, r.last_line) for r in linededup.repeated_runs(made).collect()}


def test_line_dedup_short_passages(spark):
    """One or two lines of over 50 words are found whatever stands around them."""
    passages = [sentence(f"one{i}", 60) for i in range(12)]
    passages += [sentence(f"a{i}", 30) + sentence(f"b{i}", 24) for i in range(12)]
    copies = [
        f"{sentence(f'x{i}.{k}', 6)}{sentence(f'y{i}.{k}', 6)}{p}{sentence(f'z{i}.{k}', 6)}{sentence(f'u{i}.{k}', 6)}"
        for k in range(3) for i, p in enumerate(passages)
    ]
    n = len(passages)
    assert runs_of(spark, copies) == {
        k * n + i: (2, 2 if i < 12 else 3) for k in (1, 2) for i in range(n)
    }


def test_line_dedup_frequent_pairs(spark):
    """A run is whole though its middle stands first among other lines."""
    texts, wanted = [], {}
    for i in range(20):
        pair = sentence(f"p{i}", 6) + sentence(f"q{i}", 6)
        run = sentence(f"before{i}", 9) + pair + sentence(f"after{i}", 9)
        texts.append(sentence(f"c{i}", 4) + pair + sentence(f"d{i}", 4))
        texts.append(sentence(f"e{i}", 4) + run + sentence(f"f{i}", 4))
        wanted[len(texts)] = (1, 4)
        texts.append(sentence(f"g{i}", 4) + run + sentence(f"h{i}", 4))
    assert runs_of(spark, texts) == wanted


def test_simhash(docs, none):
    assert simhash.near_duplicates(none).count() == 0
    found = {(r._id, r._version): r for r in simhash.near_duplicates(docs).collect()}
    by_id = {r._id: r for r in found.values()}
    assert by_id[2].component_id == by_id[3].component_id == by_id[6].component_id == 2
    assert by_id[2]._fp == 0 and by_id[4].component_id == by_id[5].component_id == 4
    assert by_id[None].component_id is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4]


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_simhash_plan_is_whole(parts):
    """Every number of parts with its thresholds meets every pair within the distance."""
    groups = simhash._grouped_bits(np.zeros((64, 64)), parts)
    cost, thresholds = simhash.allocate([[0.0, 1.0, 8.0, 64.0, 512.0]] * parts, 3 - parts + 1)
    assert sum(thresholds) == 3 - parts + 1
    draw = random.Random(parts)
    for _ in range(300):
        bits = draw.sample(range(64), draw.randint(0, 3))
        assert any(sum(b in g for b in bits) <= t for g, t in zip(groups, thresholds))


def test_simhash_blocks(spark):
    """Buckets cut into blocks link what all pairs link."""
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)]
    fps = set()
    for _ in range(1500):
        fp = draw.choice(base)
        for b in draw.sample(range(64), draw.randint(0, 4)):
            fp ^= 1 << b
        fps.add(simhash._signed(fp))
    nodes = spark.createDataFrame([(fp,) for fp in fps], "_fp long")
    plan = simhash.plan_parts(nodes)
    roots = dict(components(simhash.near_links(nodes, plan, block=16)).collect())
    parent = {fp: fp for fp in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert all(roots.get(fp, fp) == root(fp) for fp in fps)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    found = dict(components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect())
    assert found == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path(packing.TOKENIZER_FILE)
    assert packing.pack_documents(none, path).count() == 0
    rows = packing.pack_documents(docs, path).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for _, part in itertools.groupby(places, key=lambda p: p[0]):
        end = 0
        for _, offset, length in part:
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_packing_program():
    draw = random.Random(2)
    for size in (1, 30, 400):
        histogram = {n: draw.randint(1, size) for n in draw.sample(range(1, 65), 40)}
        plan = packing.solve(histogram, 64)
        used: dict = {}
        for config, often in plan.items():
            assert sum(length * n for length, n in config) <= 64
            for length, n in config:
                used[length] = used.get(length, 0) + n * often
        assert used == histogram
        least = -(-sum(length * n for length, n in histogram.items()) // 64)
        least = max(least, sum(n for length, n in histogram.items() if length > 32))
        assert sum(plan.values()) <= least * 1.05 + 2
    assert packing.solve({}) == {}


def test_packing_encodes_like_the_tokenizer():
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER_FILE))
    draw = random.Random(4)
    odd = [chr(c) for c in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0x1F600]]
    texts = ["", "<|endoftext|>", "a" * 5000, *("".join(draw.choices(odd + [" "] * 200, k=40)) for _ in range(500))]
    for text in texts:
        assert list(encoder.encode(text)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_encodes_special_tokens_like_the_file(spark):
    path = public_tokenizers.path(packing.TOKENIZER_FILE)
    tokenizer = Tokenizer.from_file(path)
    token = "<|endoftext|>"
    texts = [token, f"one{token}two", f"one {token} two", token * 3, f"\u4e2d{token}", "<|endoftext |>", f"a {token * 1500}"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path, with_ids=True).collect()
    for i, text in enumerate(texts):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert packing.Encoder(path).encode(text) == wanted
        found = sorted((r.piece, r.start, r.length, r.ids) for r in rows if r.doc_id == i)
        assert [k for _, _, _, ids in found for k in ids] == [*wanted, packing.END_ID]
    assert 50256 in tokenizer.encode(texts[1], add_special_tokens=False).ids


def test_bpe(spark, docs, none):
    path = public_tokenizers.path(bpe.RANKS_FILE)
    assert bpe.digests(none, path).count() == 0
    encoded = bpe.encode(docs, path)
    texts = {r._id: r.bytes for r in bpe.decode(encoded, path).collect()}
    assert texts[4] == LONG.encode() and texts[2] == texts[3] == b"" and texts[6] == b" \n\t "


def test_bpe_merges_as_the_library():
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS_FILE))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    draw = random.Random(6)
    odd = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0x1F600]]
    for text in ["", "a" * 3000, " " * 999, *("".join(draw.choices(odd + [" "] * 99, k=50)) for _ in range(500))]:
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_sharding(docs, none):
    assert sharding.assign(none).count() == 0
    found = sharding.assign(docs, shards=3).collect()
    assert sorted(r.slot * 3 + r.shard for r in found) == list(range(len(TEXTS)))


def test_numbering_of_hot_rows(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 7).otherwise(F.col("id")).alias("v"))
    found = [r.no for r in numbered(rows, 20_000, "no").collect()]
    assert sorted(found) == list(range(20_000))
    grouped = numbered(rows, 20_000, "no", F.col("v") % 2).groupBy(F.col("v") % 2).agg(
        F.min("no").alias("a"), F.max("no").alias("b"), F.countDistinct("no").alias("n")).collect()
    assert all(r.a == 0 and r.b + 1 == r.n for r in grouped)


def test_neighbours(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    rows += [(300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0]), (0, [0.0, 0.0, 1.0]), (700, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(vectors, F.col("id") % 100 == 0).toPandas()
    assert set(found.query_id) == {0, 100, 200}
    x = {i: np.array(v) for i, v in rows[:300]}
    for q, part in found.sort_values("rank").groupby("query_id"):
        true = sorted((float(np.linalg.norm(x[i] - x[q])), i) for i in x if i != q)[:10]
        assert list(zip(part.score, part.vec_id)) == true
    assert neighbours.search(vectors.limit(0), F.col("id") % 100 == 0).count() == 0


def test_hilbert_keys_are_a_walk():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = np.argsort(neighbours.hilbert_keys(cells, 3))
    assert sorted(neighbours.hilbert_keys(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_chat(spark):
    rows = [(1, 0, "user", "Hi"), (1, 0, "user", "Hi"), (1, 1, "assistant", None), (1, None, "system", "Be kind"),
            (2, 0, "system", "alone"), (None, 0, None, "x"), (1, 2, "bob", "y")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(9))
    found = chat.rotate(talks).orderBy("conv_id", "perspective", "place").collect()
    assert len(found) == 3 * 5 + 1
    for _, part in itertools.groupby(found, key=lambda r: (r.conv_id, r.perspective)):
        part = list(part)
        whole = "".join(r.rendered for r in part)
        assert [r.place for r in part] == list(range(len(part)))
        for r in part:
            assert whole[r.start : r.start + r.length] == r.rendered
            if r.mask_length:
                assert whole[r.mask_start : r.mask_start + r.mask_length].endswith("<|im_end|>\n")
                assert r.role == r.perspective
    assert chat.rotate(talks.limit(0)).count() == 0


def test_wrappers(spark):
    def page(i):
        return f"""<html><body class="post-{i}"><div id="top-menu"><ul><li><a href=/a>Home</a><li><a>News</a></ul></div>
        <div class="cookie-notice">We use cookies</div><div id=wrap><div class=left><div class="post-body">
        <h1>Title {i}</h1><p>First {i} with <b>bo</b>ld &amp; more {'x' * i}.<p>Second {i},&nbsp;longer.<br>after</p>
        <form><input>Name</form></div><div class="sidebar"><p>About {i}</p></div><div class="comments">
        <article class="comment"><p>I disagree {i}</p></article></div></div></div><script>if (a < b) c("</p>")</script>
        <footer>Copy"""

    rows = [(i, "http://a.example/x", page(i)) for i in range(1, 6)]
    rows += [(10, None, None), (11, "", ""), (12, "http://b.example", "<p>only <i>this</i>"), (12, "http://b.example", "<p>only <i>this</i>"),
             (13, "http://a.example/y", "<div><p>other kind")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("z"))
    found = [(r.page_id, r.text) for r in wrappers.main_text(pages).collect()]
    texts = dict(found)
    assert texts[3] == "Title 3 First 3 with bold & more xxx. Second 3, longer. after"
    assert texts[10] == texts[11] == "" and texts[12] == "only this" and texts[13] == "other kind"
    assert len(found) == len(rows)
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_wrappers_have_the_size_of_the_template(spark):
    """Ids and classes made of page words do not make the wrapper of a host grow."""
    def name(i, k):
        return "".join("abcdefghij"[int(c)] for c in f"{i:04}{k:02}")

    def page(i):
        parts = "".join(f"<h2 id={name(i, k)}>Head {i}.{k}</h2><p>Text {i}.{k}</p>" for k in range(12))
        return f"<html><body><nav>Menu</nav><article class='post {name(i, 99)}'>{parts}</article></body></html>"

    def sizes(n):
        rows = [(i, "http://a.example/x", page(i)) for i in range(n)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
        if n == 240:
            texts = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
            assert all(texts[i] == " ".join(f"Head {i}.{k} Text {i}.{k}" for k in range(12)) for i in range(n))
        return max(len(r.wrapper) for r in wrappers.infer(pages).collect())

    assert sizes(240) <= 1.5 * sizes(60)


def test_wrappers_are_bounded():
    """Many labels on few pages each fold into slots with all of their characters."""
    whole = wrappers.bounded(wrappers.pattern(wrappers.parse("<article><h1>Title</h1></article>")))
    for i in range(40):
        row = "".join(f"<x{i}-{k}>text</x{i}-{k}>" for k in range(100))
        made = wrappers.pattern(wrappers.parse(f"<article><h1>Title {i}</h1>{row}</article>"))
        whole = wrappers.bounded(wrappers.align(whole, made))
    assert len(wrappers.json.dumps(whole)) < 100 * wrappers.WIDTH
    assert wrappers._varying(whole, 41) >= 40 * 400
    assert wrappers.rules(whole)["main"] == ["article"]


def test_wrappers_keep_what_is_inside_articles(spark):
    """Ids of headings, sections and inline elements leave nothing out; containers do."""
    def page(i):
        return f"""<body><nav>Menu</nav><article class="post"><h1 id="notice-period">Title {i}</h1>
        <h2 id="related-work">Related {i}</h2><p id="search">Search {i} <span id="share">one</span></p>
        <section id="discussion"><h3 id="social-impact">Impact {i}</h3><p>Long text {i}</p></section>
        <p aria-hidden="false">Sum <math><mi>x</mi><mo>=</mo><mn>{i}</mn></math> ends</p>
        <div id="comments"><p>I disagree {i}</p></div><div class="share-buttons wide">Send {i}</div><aside>Aside</aside>
        <div role="navigation">Next</div></article></body>"""

    rows = [(i, "http://a.example/x", page(i)) for i in range(1, 6)]
    rows.append((9, "http://b.example/x", "<article><p>Only one</p><div class=comments>No</div><div id=widget>Yes</div></article>"))
    found = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r.page_id: r.text for r in found.collect()}
    for i in range(1, 6):
        assert texts[i] == (
            f"Title {i} Related {i} Search {i} one Impact {i} Long text {i} Sum x={i} ends"
        )
    assert texts[9] == "Only one Yes"


@pytest.mark.parametrize("tag", ["font", "span", "div", "section", "article", "aside", "x-y"])
def test_wrappers_of_deep_pages(tag):
    """Text of any depth stays in its order; what is left out stays out."""
    n = 5000
    for close in ("", f"</{tag}>"):
        inner = "".join(f"<{tag}>w{k} " for k in range(n)) + "<nav><ul><li>Menu</ul></nav><p>Deep</p>"
        inner += "".join(f"{close} v{k}" for k in range(n))
        page = f"<html><body><article><p>First</p>{inner}</article></body></html>"
        tree = wrappers.parse(page)
        whole = wrappers.align(wrappers.pattern(tree), wrappers.pattern(wrappers.parse(page)))
        rule = wrappers.rules(wrappers.json.loads(wrappers.json.dumps(wrappers.bounded(whole))))
        said = wrappers.extract(page, rule).split()
        wanted = ["First", *[f"w{k}" for k in range(n)], "Deep", *[f"v{k}" for k in range(n)]]
        if tag == "aside":
            assert said[0] == "First" and "Menu" not in said
        else:
            assert said == wanted, (close, len(said))


def test_wrappers_of_a_host_with_a_deep_page(spark):
    rows = [(i, "http://a.example", f"<body><article><p>Text {i}</p></article>") for i in range(4)]
    rows.append((9, "http://a.example", "<body><article>" + "<font><div>deep " * 3000))
    found = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r.page_id: r.text for r in found.collect()}
    assert texts[2] == "Text 2" and texts[9] == " ".join(["deep"] * 3000)
