"""Each stage of the pipeline against a brute-force version, on what its predecessor kept."""

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from listaro.llm import simhash, substring_dedup


def fixture(folder):
    rng = random.Random(11)
    words = "stone river cloud meadow lantern harbour signal winter garden copper violet saddle marble timber falcon".split()
    vocabulary = words + [a + b for a in words for b in words]
    def good():
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(25)).capitalize() + "." for _ in range(3))
    def bad():
        return "\n".join((rng.choice(words) + " ") * 25 for _ in range(3))
    texts = [good() if i % 5 else bad() for i in range(150)]
    labels = [int(i % 5 != 0) for i in range(150)]
    texts += [re.sub(" ", "  ", texts[i], count=3) for i in range(1, 30, 3)]  # equal but for white space
    for i in range(2, 30, 3):  # near copies: one word of 75 edited
        w = texts[i].split(" ")
        w[rng.randrange(5, 70)] = "edited"
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [good() + "\n" + passage + ".\n" + good() for _ in range(4)] + [None, ""]
    n = len(texts)
    docs = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": [f"s{i % 3}" for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(docs, f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(150), pa.int64()), "quality": pa.array(labels, pa.int32()), "toxic": pa.array([0] * 150, pa.int32())}), f"{folder}/labels.parquet")
    return texts, labels


def test_stages(spark, tmp_path):
    texts, labels = fixture(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == columns, name
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted((r.asDict() for r in (docs if i < 4 else out).collect()), key=lambda r: r["doc_id"]))
    quality, exact, near, cut, packed = kept
    ids = [{r["doc_id"] for r in rows} for rows in kept]
    assert all((i in ids[0]) == bool(labels[i]) for i in range(150))

    firsts = {}
    for r in quality:
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert ids[1] == set(firsts.values())

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + simhash.SHINGLE]) for i in range(max(1, len(w) - simhash.SHINGLE + 1))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in exact}
    parent = {i: i for i in ids[1]}
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in ids[1]:
        for b in ids[1]:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= simhash.SIMILARITY * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert ids[2] == {i for i in ids[1] if find(i) == i} and len(ids[2]) < len(ids[1])

    span = substring_dedup.SPAN
    data = {r["doc_id"]: (r["text"] or "").encode() for r in near}
    seen = {}
    for d in data.values():
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    for r in cut:
        d = data[r["doc_id"]]
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        assert r["text"].encode() == bytes(np.frombuffer(d, np.uint8)[~gone]) and r["n_chars"] == len(r["text"])
    assert ids[3] == ids[2] and sum(len(r["text"] or "") for r in cut) < sum(map(len, data.values()))
    assert ids[4] == ids[3] and all(r["n_tokens"] == len(t["text"].split()) for r, t in zip(packed, cut))


def test_run_gives_the_last_stage(spark, tmp_path):
    fixture(tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_run_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts and empty tables go through all stages."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    labels = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    rows = [(None, "a text without an id"), (1, None), (1, ""), (2, "b " * 300), (2, "b " * 300), (3, "c")]
    for name, docs, known in (("empty", [], []), ("odd", [(i, t, None, None, None) for i, t in rows], [(1, 1, 0), (None, 0, None), (2, None, 0)])):
        (tmp_path / name).mkdir()
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in docs], schema), f"{tmp_path}/{name}/documents.parquet")
        pq.write_table(pa.Table.from_pylist([dict(zip(labels.names, r)) for r in known], labels), f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() <= len(docs)


def test_near_copies_of_the_given_documents(spark):
    """Of the pairs of sf0.01 and of edited copies of it with a five-word similarity of 0.8 or more, at least nine in ten are found."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").filter("length(text) between 300 and 3000").limit(200).toPandas()
    rng, texts = random.Random(5), []
    for text in sorted(set(given["text"]))[:150]:
        words = text.split()
        for edits in (0, len(words) // 60):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = "edited" + str(rng.randrange(1000))
            texts.append(" ".join(own))
    sets = [simhash.shingle_hashes(t, simhash.SHINGLE) for t in texts]
    similar = [(i, i + 1) for i in range(0, len(texts), 2) if len(np.intersect1d(sets[i], sets[i + 1])) >= 0.8 * len(np.union1d(sets[i], sets[i + 1]))]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(j not in kept for _, j in similar)
    assert len(similar) > 80 and found >= 0.9 * len(similar)
    # What goes is similar to something: no text goes for its vocabulary alone.
    for j in set(range(len(texts))) - kept:
        assert any(len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) for i in range(len(texts)) if i != j)


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def similarity_roots(texts):
    """Each text's smallest one that pairs of similarity 0.8 or more lead to."""
    sets = [simhash.shingle_hashes(t, simhash.SHINGLE) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i]) and len(sets[j]) and jaccard(sets[i], sets[j]) >= simhash.SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_an_unlike_first_text_hides_no_copies(spark):
    """The same words in another order have the same word fingerprints, but other shingles; the others of the group still meet."""
    rng = random.Random(2)
    texts = []
    for g in range(12):
        words = [f"w{g}x{rng.randrange(4000)}" for _ in range(90)]
        other = rng.sample(words, len(words))
        edited = list(words)
        edited[rng.randrange(20, 70)] = "edited"
        texts += [" ".join(other), " ".join(words), " ".join(words).upper(), " ".join(edited)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    roots = similarity_roots(texts)
    assert kept == {i for i, r in enumerate(roots) if i == r} and len(kept) == 24


def test_a_large_group_is_one(spark, monkeypatch):
    """Copies with edits of their own, in more fingerprints than a bucket pairs, and compared a few at a time."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "GROUP_BYTES", 4000)
    rng = random.Random(3)
    base = [f"word{rng.randrange(500)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(200)] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.sample(base, 200)) for _ in range(5)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {i for i, r in enumerate(similarity_roots(texts)) if i == r} == {0, *range(150, 155)}


def test_recall_on_groups_of_the_given_documents(spark):
    """Groups of four edited copies of each of 60 given texts, and all pairs among all given ones: at least nine in ten of those that are similar end in one group."""
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").filter("length(text) between 300 and 3000").limit(400).toPandas()["text"].tolist()
    rng, texts = random.Random(9), given[:240]
    for text in sorted(set(given[240:]))[:60]:
        for _ in range(4):
            words = text.split()
            for at in rng.sample(range(len(words)), max(1, len(words) // 70)):
                words[at] = f"edited{rng.randrange(1000)}"
            texts.append(" ".join(words))
    roots = similarity_roots(texts)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lost = {i for i, r in enumerate(roots) if i != r}
    assert len(lost) > 80 and len(lost - kept) >= 0.9 * len(lost)
    assert set(range(len(texts))) - kept <= lost


def test_no_pair_under_a_key_is_left_out(spark, monkeypatch):
    """All documents under one key, the first unlike all others: pairs that share no further band key are found too."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(41)]
    for text in texts[1:41]:
        words = text.split()
        words[30], words[90] = "other", "another"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(simhash, "candidate_keys", lambda *_: simhash.stage(rows.selectExpr("1L AS key", "0 AS band", "id"), "test-keys"))
    found = {(r.u, r.v) for r in simhash.near_copy_edges(rows, 3, simhash.TABLES, simhash.SHINGLE, simhash.SIMILARITY).collect()}
    assert found == {(i, i + 40) for i in range(1, 41)}


def test_unlike_documents_under_a_key_make_no_pairs(spark):
    """300 copies with edits of their own under one key are unlike; of them only the pairs with a common edit are looked at, and all similar ones are found."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(60), 3):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    for text in texts[:20]:
        texts.append(text + " more")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = simhash.shingle_sets(rows, rows.select("id"), simhash.SHINGLE)
    keys, none = rows.selectExpr("1L AS key", "id"), spark.createDataFrame([], "u long, v long")
    left = simhash.remaining_pairs(keys, none, sets, simhash.SIMILARITY)
    found = {(r.u, r.v) for r in simhash.similar_pairs(left, sets, simhash.SIMILARITY).collect()}
    own = [simhash.shingle_hashes(t, simhash.SHINGLE) for t in texts]
    assert found == {(i, j) for j in range(320) for i in range(j) if jaccard(own[i], own[j]) >= simhash.SIMILARITY} >= {(i, i + 300) for i in range(20)}
    assert left.count() < 1000


def test_remaining_pairs_of_any_size(spark):
    """Sets of few hashes, of which many are common, against all pairs."""
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = simhash.shingle_sets(rows, rows.select("id"), 2)
    left = simhash.remaining_pairs(rows.selectExpr("id % 2 AS key", "id"), spark.createDataFrame([], "u long, v long"), sets, 0.8)
    found = {(r.u, r.v) for r in simhash.similar_pairs(left, sets, 0.8).collect()}
    own = [simhash.shingle_hashes(t, 2) for t in texts]
    wanted = {(i, j) for j in range(250) for i in range(j) if jaccard(own[i], own[j]) >= 0.8}
    assert {(i, j) for i, j in wanted if (j - i) % 2 == 0} <= found <= wanted


def test_a_dense_group_of_fingerprints_makes_few_edges(spark):
    near = [0x5A5A5A5A << 32 | 1 << i | 1 << j for i in range(24) for j in range(i)]
    far = [i * 0x1234567 << 32 | i for i in range(1, 40)]
    edges, held = simhash.links_and_tables(spark.createDataFrame([(x,) for x in near + far], "fp long"), 3, exact=False)
    found = edges.distinct().collect()
    for table in held:
        simhash.drop_stage(table)
    # All pairs of the group within 3 bits would be over 6,000.
    assert len(found) < 4 * len(near)
    roots = {x: x for x in near}
    def root(x):
        return x if roots[x] == x else root(roots[x])
    for r in found:
        roots[root(r.u)] = root(r.v)
    assert len({root(x) for x in near}) == 1
