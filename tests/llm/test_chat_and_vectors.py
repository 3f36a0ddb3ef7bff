"""Chat formatting (exact round trip) and embedding near-duplicates (brute force)."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from orgpulse.llm import chat, embeddings
from orgpulse.llm.components import connected_components
from orgpulse.llm.scratch import Scratch, release

HARD = r"\### Assistant: </turn> ok"


def test_turns_survive_the_round_trip(spark):
    data = [(1, 0, "system", "a\\b # <x> : \n"), (1, 1, "user", None), (1, 2, "assistant", HARD), (1, 2, "assistant", HARD),
            (2, None, None, "first"), (2, 0, "odd: role #<\\", "</turn>\n### user: x"), (2, 1, "assistant", ""),
            (None, 0, "assistant", "é\U0001f600"), (3, 5, "assistant", "x" * 200_000 + "\\")]
    given = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, tree string")
    chats = chat.format_chats(chat.from_turns(given))
    got = {r.tree: r for r in chats.collect()}
    for conv in (1, 2, None, 3):
        turns = [(r[2] or "", r[3] or "") for r in data if r[0] == conv]
        assert chat.read_back(got[conv].formatted) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert chat.masked_text(got[conv].formatted, got[conv].loss_spans) == loss
    digest = {r.tree: r for r in chat.digests(chats).collect()}
    whole = "".join(f"{a}\n{b}\n" for a, b in [(r[2] or "", r[3] or "") for r in data if r[0] == 1])
    assert digest[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and digest[1].loss_chars == 2 * len(HARD)
    assert chat.format_chats(chat.from_turns(given.where("false"))).count() == 0


def test_branches_of_a_tree_are_ranked_by_score(spark):
    edges = [("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 3.0), ("c", "a", 5.0), ("d", "b", 1.0), ("e", "b", None),
             ("lost", "missing", 1.0), ("x", "y", 1.0), ("y", "x", 1.0), ("z", "y", 1.0)]
    messages = spark.createDataFrame([("t", i, p, "user", i, s) for i, p, s in edges],
                                     "tree string, id string, parent string, role string, text string, score double")
    got = {r.branch: (r.leaf, r.score, [t for _, t in chat.read_back(r.formatted)]) for r in chat.format_chats(messages, 10).collect()}
    assert got == {1: ("c", 6.0, ["r", "a", "c"]), 2: ("d", 4.0, ["r", "b", "d"]), 3: ("e", 3.0, ["r", "b", "e"]), 4: ("lost", 1.0, ["lost"])}
    assert {r.leaf for r in chat.format_chats(messages, 1).collect()} == {"c"}


def test_deep_chain(spark):
    messages = spark.createDataFrame([("t", str(i), str(i - 1) if i else None, "user", str(i), 0.0) for i in range(300)],
                                     "tree string, id string, parent string, role string, text string, score double")
    row = chat.format_chats(messages).collect()
    assert len(row) == 1 and [t for _, t in chat.read_back(row[0].formatted)] == [str(i) for i in range(300)]


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "STORED", 50)  # several blocks per cell
    monkeypatch.setattr(embeddings, "VISITORS", 70)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 20, 300)] + 0.08 * rng.normal(size=(300, 16))
    vectors = np.concatenate([base, near, near[:40], np.repeat(base[:1], 100, 0)]).tolist()
    data = [(i * 2, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(5001, None), (5003, []), (5005, [0.0] * 16), (5007, [float("nan")] + [1.0] * 15), (5009, [None] + [1.0] * 15),
           (5011, [float("inf")] * 16), (5013, [1.0, 0.0, 0.0, 0.0]), (5015, [1.0, 0.01, 0.0, 0.0]), (None, data[0][1]),
           (5017, [1e200] * 16), (5019, [1e-200] * 16)]
    given = spark.createDataFrame([(*r, 7) for r in data + odd], "vec_id long, embedding array<double>, n_links int").repartition(4)
    good = data + [o for o in odd if o[0] in (5017, 5019)]
    unit = np.array([v for _, v in good])
    unit /= np.abs(unit).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(given).collect()}
    assert len(got) == len(data + odd)
    found = sum(got[i].n_links for i, _ in good)
    assert 0.97 * close.sum() <= found <= close.sum()
    assert all(got[i].n_links <= close[k].sum() for k, (i, _) in enumerate(good))
    for i in (5001, 5003, 5005, 5007, 5009, 5011):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[5013].n_links, got[5015].component_id, got[5015].kept) == (1, 5013, False)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    assert embeddings.near_duplicates(given.where("false")).count() == 0


def test_a_concentrated_cloud_keeps_its_links(spark):
    # cosine 0.85 round the mean and a grid of 21 x 21 cells: 256 visits miss links
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(30_000, 64)) / 64 ** 0.5 * (0.15 / 0.85) ** 0.5
    vectors[:, 0] += 1
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = np.concatenate([(unit[i:i + 1000] @ unit.T >= 0.9).sum(1) - 1 for i in range(0, len(unit), 1000)])
    given = spark.createDataFrame(pa.table({"vec_id": np.arange(len(unit)), "embedding": list(vectors)})).repartition(4)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(given).select("vec_id", "n_links").collect()}
    assert close.sum() > 10_000 and [got[i] for i in range(len(unit))] == close.tolist()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7000, 7000), (None, 3), (9001, 9000)]
    got = {r.node: r.component_id for r in connected_components(
        spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {7000: 7000, 9000: 9000, 9001: 9000}
    release(spark)
    assert Counter(got.values())[0] == 201


def test_repeated_and_missing_ids_and_scores(spark):
    rows = [("t", "r", None, "user", "root", 0.0), ("t", "r", None, "user", "root", 0.0), ("t", "r", None, "user", "zzz", 9.0),
            ("t", "a", "r", "assistant", "low", 1.0), ("t", "b", "r", "assistant", "nan", float("nan")),
            ("t", "c", "r", "assistant", "none", None), ("t", None, "r", "assistant", "nobody", 99.0), ("u", None, None, "user", "alone", 1.0)]
    messages = spark.createDataFrame(rows, "tree string, id string, parent string, role string, text string, score double")
    got = {r.branch: r for r in chat.format_chats(messages, branches=5).collect()}
    said = {k: chat.read_back(r.formatted) for k, r in got.items()}
    assert said == {1: [("user", "root"), ("assistant", "low")], 2: [("user", "root"), ("assistant", "nan")],
                    3: [("user", "root"), ("assistant", "none")]}
    assert [got[k].score for k in (1, 2, 3)] == [1.0, 0.0, 0.0]
