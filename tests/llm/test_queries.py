"""The registered training-data queries against SQL or plain brute-force versions."""

import base64
import collections
import hashlib
import html
import math
import pathlib
import re
import zlib
from types import SimpleNamespace

import compare
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from testpulse.llm import sharding, simhash
from testpulse.llm.catalog import QUERIES

FOLDER = f"{compare.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def result(spark, name):
    return QUERIES[name][0](spark, FOLDER).toPandas()


def components(fps, distance):
    """Least member reachable over links of up to ``distance`` bits, by all pairs."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_sql(spark, name):
    run, sql = QUERIES[name]
    query = SimpleNamespace(run=run, sql=sql)
    assert compare.check(spark, compare.connection(FOLDER), name, query, FOLDER) is None


def test_op1_recall_and_scores(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), dtype=float), rows.vec_id.to_numpy()
    found = {q: part.sort_values("rank") for q, part in result(spark, "op1_neighbours").groupby("query_id")}
    queries = ids[ids % 100 == 0]
    assert set(found) == set(queries.tolist())
    hits = 0
    for q in queries:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        mine = found[q]
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1))
        assert q not in set(mine.vec_id)
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        for row in mine.itertuples():
            assert row.score == pytest.approx(far[ids == row.vec_id][0], abs=1e-12)
        hits += len(set(ids[true]) & set(mine.vec_id))
    assert hits >= 0.9 * 10 * len(queries)


def test_op2_pieces_and_places(spark, documents):
    found = result(spark, "op2_packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, pieces in found.sort_values("piece").groupby("doc_id"):
        text = documents.loc[documents.doc_id == doc_id, "text"].iloc[0]
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert pieces.piece.tolist() == list(range(len(pieces)))
        assert pieces.length.sum() == len(ids)
        assert (pieces.length.iloc[1:] == 1024).all() and pieces.length.iloc[0] <= 1024
        for p in pieces.itertuples():
            part = np.array(ids[p.start : p.start + p.length], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
    assert set(found.doc_id) == set(documents.doc_id)
    for _, sequence in found.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        assert sequence.length.sum() <= 1024
    assert found.sequence_id.nunique() <= math.ceil(found.length.sum() / 1024) * 1.02 + 2


def test_op4_scores(spark, documents):
    found = result(spark, "op4_toxicity")
    assert sorted(found.doc_id) == sorted(documents.doc_id)
    assert found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]
    assert found.held_out.tolist() == held
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    both = labels.merge(found, on="doc_id")
    toxic, clean = both[both.toxic == 1], both[both.toxic == 0]
    assert toxic.score.mean() > clean.score.mean() + 0.2
    assert clean.predicted.mean() < 0.1


def test_op6_text_of_articles(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").toPandas().set_index("page_id")
    found = result(spark, "op6_main_text")
    assert sorted(found.page_id) == sorted(pages.index)
    for row in found.itertuples():
        article = re.search(r"<article>(.*?)</article>", pages.html[row.page_id], re.S)[1]
        spaced = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] == "b" else " ", article)
        assert row.text == " ".join(html.unescape(spaced).split())
        assert row.n_chars == len(row.text)


def test_op7_fingerprints_and_components(spark, documents):
    found = result(spark, "op7_simhash").set_index("doc_id")
    fps = []
    for row in documents.itertuples():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), row.text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = [sum(h >> b & 1 for h in hashed) * 2 > len(hashed) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if bits[b]))
        assert found.fingerprint[row.doc_id] == f"{fps[-1]:016x}"
    ids = documents.doc_id.tolist()
    least: dict = {}
    roots = components(fps, 3)
    for r, d in zip(roots, ids):
        least[r] = min(least.get(r, d), d)
    assert [found.component_id[d] for d in ids] == [least[r] for r in roots]


def test_op8_law_and_inverse(spark, documents):
    found = result(spark, "op8_sharding")
    texts = dict(zip(documents.doc_id, documents.text))
    assert sorted(found.doc_id) == sorted(texts)
    counts = found.groupby("shard").slot.agg(["count", "max"])
    assert (counts["max"] + 1 == counts["count"]).all() and counts["count"].max() - counts["count"].min() <= 1
    for row in found.itertuples():
        raw = texts[row.doc_id].encode()
        assert row.size == len(raw) + 8 and row.text_crc32 == zlib.crc32(raw)
    n = len(found)
    back = QUERIES["op8_sharding"][0](spark, FOLDER).select(
        "row_number", sharding.row_number_of(F.col("shard"), F.col("slot"), n).alias("back")
    )
    assert back.filter("row_number <> back").count() == 0
    again = QUERIES["op8_sharding"][0](spark, FOLDER).repartition(7).toPandas()
    assert sorted(map(tuple, again[["doc_id", "shard", "slot"]].to_numpy())) == sorted(
        map(tuple, found[["doc_id", "shard", "slot"]].to_numpy()))


def plain_lines(text):
    parts = re.split(r"(?<=\n)|(?<=[.!?][ \t])", text)
    return [" ".join(w) for p in parts if (w := re.findall(r"[^\x20\x09-\x0D]+", p))]


def test_op9_every_deleted_line_is_earlier(spark, documents):
    found = result(spark, "op9_line_dedup")
    lines = {r.doc_id: plain_lines(r.text) for r in documents.itertuples()}
    first: dict = {}
    for d in sorted(lines):
        for i, line in enumerate(lines[d]):
            first.setdefault(line, (d, i))
    for row in found.itertuples():
        part = lines[row.doc_id][row.first_line : row.last_line + 1]
        assert sum(len(x.split()) for x in part) == row.n_words >= 25
        for i, line in enumerate(part, start=row.first_line):
            assert first[line] < (row.doc_id, i)
    # Runs of three lines or more and 25 words that occur earlier as they are, are found.
    covered = collections.defaultdict(set)
    for row in found.itertuples():
        covered[row.doc_id] |= set(range(row.first_line, row.last_line + 1))
    seen: dict = {}
    for d in sorted(lines):
        for i in range(len(lines[d]) - 2):
            run = tuple(lines[d][i : i + 3])
            if run in seen and sum(len(x.split()) for x in run) >= 25:
                assert covered[d] & {i, i + 1, i + 2}, (d, i)
            seen.setdefault(run, (d, i))


def test_op10_as_the_library(spark, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = result(spark, "op10_byte_bpe").set_index("doc_id")
    for row in documents.itertuples():
        ids = library.encode_ordinary(row.text)
        mine = found.loc[row.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_pipeline(spark, documents):
    import corpus_pipeline
    from testpulse.session import stage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = [set(documents.doc_id)]
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, FOLDER), name)
        if name != "packing":
            assert after.columns == columns
            kept.append({r.doc_id for r in after.select("doc_id").collect()})
            assert kept[-1] <= kept[-2]
        if name == "simhash":
            fps = [simhash.fingerprint(r.text) for r in after.select("text").collect()]
            assert len(set(components(fps, 3))) == len(fps)
            groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
            assert groups == after.count()
        docs = after
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept[-1]
    judged = QUERIES["op3_quality_rules"][0](spark, FOLDER).filter("kept").select("doc_id").collect()
    assert kept[1] == {r.doc_id for r in judged}
