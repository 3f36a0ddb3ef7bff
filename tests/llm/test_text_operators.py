"""Operators on texts against brute force, on documents with all awkward cases, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from orgpulse.llm import decontaminate, jaccard, licenses, lines, mixing, passages, quality, sharding
from tests.llm.fixtures import docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(links, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute_components(data, n, num, den):
    sets = {i: shingle_set(t, n) for i, t, *_ in data if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, components(links, sets)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (1, 1, 2)])
def test_jaccard_components(spark, n, num, den):
    data = rows()
    sets, expected = brute_components(data, n, num, den)
    got = jaccard.similar_documents(docs(spark, data), n, num, den).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])


def test_jaccard_lists_that_the_first_round_leaves_open(spark):
    # 0 is the head of every list but similar to 3 only; 1 and 2 are similar to each other
    common = [f"c{i}" for i in range(20)]
    texts = [common + [f"a{i}" for i in range(8)], common + [f"b{i}" for i in range(8)],
             common + [f"b{i}" for i in range(7)] + ["z"], common + [f"a{i}" for i in range(7)] + ["y"]]
    data = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs(spark, data), 1, 4, 5).collect()}
    assert got == brute_components(data, 1, 4, 5)[1] == {0: 0, 1: 1, 2: 1, 3: 0}


def test_jaccard_of_sets_that_share_a_passage(spark):
    # a passage of 60 words in sets of all sizes round the threshold, in clusters and alone
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(150):
        own = [f"u{i // 3 if i % 2 else i}-{k}" for k in range(rng.randrange(0, 24))]
        texts.append(passage[rng.randrange(3):] + own + [f"x{i}"] * (i % 3))
    texts += [[f"s{i % 5}"] * 2 + [f"t{k}" for k in range(i)] for i in range(1, 45)]
    data = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    for n, num, den in ((1, 4, 5), (1, 9, 10), (2, 4, 5)):
        got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs(spark, data), n, num, den).collect()}
        assert got == brute_components(data, n, num, den)[1]


def test_entries_at_late_places_meet_no_equal_sizes(spark):
    # a shared shingle behind 15 others of 100: sets of like sizes that share no earlier one aren't similar
    entries = [(1, i, 100 + i % 4, 15, i) for i in range(200)] + [(k, i, 100, k, i) for k in range(2, 5) for i in (500, 501)]
    rest = spark.createDataFrame(entries, "shingle long, set_id long, n int, place int, component long")
    assert {tuple(r) for r in jaccard._candidates(rest, 4, 5).collect()} == {(500, 501)}


def test_one_of_each_component_stays(spark):
    data = rows()
    sets, component = brute_components(data, 5, 4, 5)
    kept = jaccard.keep_one_of_each(docs(spark, data))
    assert kept.columns == docs(spark, data).columns
    got = Counter(r.doc_id for r in kept.collect())
    expected = Counter(i for i in sets if not sets[i] or component[i] == i) + Counter(i for i, *_ in data if i is None)
    assert got == expected


def test_contained_items_are_exactly_those_of_brute_force(spark):
    data = rows()
    items = [(1, " ".join(data[2][1].split(" ")[30:70])), (2, "never seen at all in here"), (3, None), (4, ""), (5, "one"),
             (None, data[0][1][:120]), (7, " ".join(data[3][1].split(" ")[10:40]).upper() + "!"), (7, "two words"),
             (8, " ".join(data[3][1].split(" ")[10:34] + ["other"] * 3)), (9, " ".join(data[3][1].split(" ")[0:16] + data[5][1].split(" ")[20:40]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, size string")

    def grams(text, n=5):
        w = re.findall(r"[0-9_a-zA-Z\u0080-\U0010ffff]+", text or "")
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
        return w, {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    expected = Counter()
    for doc_id, text, *_ in data:
        dw, dg = grams(text)
        for item_id, t in items:
            iw, ig = grams(t)
            if len(iw) >= 5:
                if len(ig & dg) >= 0.8 * len(ig) - 1e-9:
                    expected[doc_id, item_id, len(ig & dg)] += 1
            elif iw and any(dw[i:i + len(iw)] == iw for i in range(len(dw) - len(iw) + 1)):
                expected[doc_id, item_id, 1] += 1
    got = Counter((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained_items(docs(spark, data), bench).collect())
    assert got == expected and len(expected) > 10
    dirty = {d for d, _, _ in expected}
    clean = decontaminate.keep_clean(docs(spark, data), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, *_ in data if i not in dirty) + Counter(
        {None: sum(1 for i, t, *_ in data if i is None and t is None)} if None in dirty else {})


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows()[:8])], "item_id long, text string")
    whole = decontaminate.contained_items(docs(spark), bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 100)
    assert Counter(whole) == Counter(decontaminate.contained_items(docs(spark), bench).collect())


def test_mix_meets_its_targets(spark):
    data = rows(n=120)
    got = mixing.mix_plan(docs(spark, data)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in data)
    names = sorted({s for *_, s in data if s is not None}) + [None]
    total = {s: sum(size(t) for _, t, _, x in data if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while True:  # reshare the excess until none is above twice its size
        level = left / max(sum(weight[s] for s in free), 1e-9)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    source = {i: s for i, _, _, s in data if i is not None}
    for r in got:
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    for s in names:
        own = [r for r in got if r.doc_id is not None and source[r.doc_id] == s]
        if s not in ("s0", "s1"):  # those hold rows without a doc_id
            assert abs(sum(r.taken for r in own) - target[s]) <= max([r["size"] for r in own], default=0)
    assert Counter(got) == Counter(mixing.mix_plan(docs(spark, data).repartition(7)).collect())
    mixed = mixing.mixed_documents(docs(spark, data))
    assert mixed.columns == docs(spark, data).columns
    assert Counter(r.doc_id for r in mixed.collect()) == sum((Counter({r.doc_id: r.copies}) for r in got), Counter())


def test_shards_are_balanced_and_grow_only_into_the_new_one(spark):
    data = [(i + 10000, f"text {i}", "en", "s") for i in range(4000)] + rows()[-12:]
    got = sharding.shard_plan(docs(spark, data)).collect()
    for r in got:
        assert r.grown_shard == r.shard or r.grown_shard == 8
    by_shard = Counter(r.shard for r in got)
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) < 1.25 * min(by_shard.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by_shard[s]))
    text = {i: t for i, t, *_ in data if i is not None}
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert Counter(got) == Counter(sharding.shard_plan(docs(spark, data).repartition(5)).collect())


def test_a_heavier_rack_gains_from_its_own_region_only(spark):
    tree = sharding.even_tree()
    data = [(i, "t", "en", "s") for i in range(3000)]
    before = {r.doc_id: r for r in sharding.shard_plan(docs(spark, data), tree).collect()}
    heavier = [(g, k, s, 2.0 if k == 0 else w) for g, k, s, w in tree]
    for r in sharding.shard_plan(docs(spark, data), heavier).collect():
        old = before[r.doc_id]
        if r.region != old.region:
            assert r.region == 0  # the region that became heavier
        elif r.rack != old.rack:
            assert r.rack == 0
        else:
            assert r.shard == old.shard


def test_sharded_documents_keep_their_columns(spark):
    assert sharding.sharded_documents(docs(spark)).columns == [*docs(spark).columns, "shard_", "slot"]


def brute_passages(data, length):
    order = sorted({(i, t or "") for i, t, *_ in data}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, out = set(), {}
    for doc_id, text in order:
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            string = raw[s:s + length]
            if string in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(string)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id, text] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_passages_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 1000)  # documents of several pieces
    data = rows(n=90) + [(2000, "a" * 500, "en", "s"), (2001, "b" + "a" * 200, "en", "s"), (2002, "ab" * 150, "en", "s"),
                         (2003, "x" + "ab" * 100 + "c" * 130 + "ab" * 60, "en", "s")]
    data = [d for d in data if not (d[0] is None and d[1] is None)]
    expected = brute_passages(data, 100)
    got = passages.remove_repeats(docs(spark, data)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    text = {i: t or "" for i, t, *_ in data}
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.sha) == expected[r.doc_id, text[r.doc_id]], r.doc_id


def cut_lines(ls, divisor):
    """Chunks of lines, with Python integers: a chunk of two lines or more ends where the mixed sum over the
    hashes of this line and the one before is divisible, unless a single line would be left."""
    golden, top = 0x9E3779B97F4A7C15, 1 << 64
    hashed = [xxhash.xxh64_intdigest(x) for x in ls]
    start = 0
    for k in range(len(ls)):
        x = (hashed[k] * golden + (hashed[k - 1] * golden * golden if k else 0)) % top
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ x >> 27) * 0x94D049BB133111EB % top
        if (x ^ x >> 31) % divisor == 0 and k + 1 - start > 1 and len(ls) - k - 1 != 1 or k == len(ls) - 1:
            yield ls[start:k + 1]
            start = k + 1


def test_line_chunks_against_brute_force(spark):
    base = rows()
    pool = [f"line number {i % 7} of {i % 5}" for i in range(40)]
    data = [(i, "\n".join(pool[k % 40] for k in range(i % 9, i % 9 + 6 + i % 11)) + f"\n{i}", "en", "s") for i in range(40)]
    data += [d for d in base[-13:] if d[0] is not None]  # one doc_id of the 40 again, with another text
    table = docs(spark, data)
    order = {(r.doc_id, r.text): (r.doc_id, r.variant) for r in table.withColumn("variant", F.xxhash64("text")).collect()}
    seen, expected = {}, {}
    for key in sorted(order, key=order.get):
        kept, lost, own = [], 0, {}
        for chunk in map(tuple, cut_lines((key[1] or "").encode().split(b"\n"), 3)):
            if len(chunk) > 1 and (seen.get(chunk, key) != key or chunk in own):
                lost += len(chunk)
            else:
                kept += chunk
                own[chunk] = seen.setdefault(chunk, key)
        expected[key] = (None if key[1] is None else b"\n".join(kept).decode(), lost)
    got = lines.dedup_lines(table).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    assert Counter((r.doc_id, r.text, r.removed_lines) for r in got) == Counter((i, *expected[i, t]) for i, t, *_ in data)
    assert sum(lost for _, lost in expected.values()) > 100


def test_boundaries_move_only_near_a_change():
    ls = [f"line {i}".encode() for i in range(400)]
    ends = lines.chunk_ends(ls, 4)
    assert lines.chunk_ends(b"\n".join(ls).split(b"\n")[:200] + [b"new"] + ls[200:], 4)[-20:] == [e + 1 for e in ends[-20:]]


def test_planted_passages_go_from_other_surroundings(spark):
    rng = random.Random(4)
    line = lambda: f"line {rng.getrandbits(64)}"
    least, data = {5: 0.5, 6: 0.6, 8: 0.7, 10: 0.8, 20: 0.9}, []
    planted = {n: [[line() for _ in range(n)] for _ in range(200)] for n in least}
    for n, passages_ in planted.items():
        for k, passage in enumerate(passages_):
            for copy in (0, 1):
                around = [[line() for _ in range(rng.randrange(1, 7))] for _ in (0, 1)]
                data.append((copy * 100_000 + n * 1000 + k, "\n".join(around[0] + passage + around[1]), "en", "s"))
    whole = [(200_000 + 2 * k + copy, "\n".join(f"whole {k} {i}" for i in range(k)), "en", "s") for k in range(2, 60) for copy in (0, 1)]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, data + whole), chunkings=8).collect()}
    assert all(got[i].text == t for i, t, *_ in data if i < 100_000)
    for n, share in least.items():
        assert sum(got[100_000 + n * 1000 + k].removed_lines for k in range(200)) >= share * 200 * n, n
        for k, passage in enumerate(planted[n]):  # what goes is of the passage
            given = next(t for i, t, *_ in data if i == 100_000 + n * 1000 + k).split("\n")
            assert set(given) - set(got[100_000 + n * 1000 + k].text.split("\n")) <= set(passage)
    for i, text, *_ in whole:
        lost = text.count("\n") + 1 if i % 2 else 0
        assert (got[i].removed_lines, got[i].text) == (lost, "" if lost else text)


def test_licences_by_dice(spark):
    notice = dict(licenses.TEMPLATES)["MIT"]
    data = [(1, "Hello there.\nReleased under the MIT License.\nBye now.", "en", "s"), (2, "released UNDER the mit, license", "en", "s"),
            (3, notice, "en", "s"), (3, notice, "en", "s"), (4, "x\n\n" + notice.replace(" ", "\n") + "\n\ny", "en", "s"),
            (5, "Released under no license", "en", "s"), (6, None, "en", "s"), (7, "", "en", "s"), (None, notice, "en", "s"),
            (8, "word " * 50000, "en", "s")]
    got = {(r.doc_id, r.license_id): (r.dice, r.n_units) for r in licenses.license_matches(docs(spark, data)).collect()}
    assert got == {(1, "MIT"): (1.0, 1), (2, "MIT"): (1.0, 1), (3, "MIT"): (1.0, 1), (4, "MIT"): (1.0, 1), (None, "MIT"): (1.0, 1)}


def found_licences(spark, texts, **options):
    data = [(i, t, "en", "s") for i, t in enumerate(texts)]
    out = [{} for _ in texts]
    for r in licenses.license_matches(docs(spark, data), **options).collect():
        out[r.doc_id][r.license_id] = (round(r.dice, 9), r.n_units)
    return out


def test_every_licence_is_reported_as_itself(spark):
    given = [(name, around) for name, t in licenses.TEMPLATES for around in (
        f"See the NOTICE file for more about who owns this; {t} Bug reports are welcome at the usual place.",
        "/*\n * Copyright (c) somebody\n *\n" + "".join(f" * {w}\n" for w in t.split(" ")) + " */\nint main;")]
    got = found_licences(spark, [t for _, t in given])
    assert [list(g.items()) for g in got] == [[(name, (1.0, 1))] for name, _ in given]


def test_licences_cut_short_and_repeated(spark):
    named = dict(reversed(licenses.TEMPLATES))  # the first template of each
    mit, bsd = [t for n, t in licenses.TEMPLATES if n == "MIT"][1], [t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause"][1]
    first = named["BSD"] + ": 1. Redistributions of source code must retain the above copyright notice."
    got = found_licences(spark, [first, "\n".join([named["Apache-2.0"]] * 1500), mit + "\n" + bsd,
                                 named["GPL-2.0"].replace("version 2", "version two"), "the of and " * 400])
    assert list(got[0]) == ["BSD"] and got[1] == {"Apache-2.0": (1.0, 1500)}
    assert got[2] == {"MIT": (1.0, 1), "BSD-2-Clause": (1.0, 1)}
    assert set(got[3]) == {"GPL-1.0", "GPL-2.0", "GPL-3.0"} and got[4] == {}  # equal ones all stay


def brute_licences(text, templates, threshold):
    """Every run of words against every template."""
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]
    grams = list(zip(words, words[1:]))
    units = []
    for k, (name, t) in enumerate(templates):
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", t)]
        bag = Counter(zip(w, w[1:]))
        for s in range(len(grams)):
            best = max(((2.0 * m / (e - s + 1 + bag.total()), m, s, e) for e in range(s, len(grams))
                        if (m := (Counter(grams[s:e + 1]) & bag).total()) and grams[s] in bag), default=None)
            if best and best[0] >= threshold - 1e-9:
                units.append((k, name, *best))
    meet = lambda x, y: x[4] <= y[5] and x[5] >= y[4]
    own = [u for u in units if not any(x[0] == u[0] and meet(x, u) and (x[2], x[3], -x[4]) > (u[2], u[3], -u[4]) for x in units)]
    kept = [u for u in own if not any(meet(x, u) and ((x[3], x[2]) > (u[3], u[2]) or (
        (x[3], x[2], x[1]) == (u[3], u[2], u[1]) and x[0] < u[0])) for x in own)]
    return {n: (round(max(u[2] for u in kept if u[1] == n), 9), sum(u[1] == n for u in kept)) for n in {u[1] for u in kept}}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_licences_against_brute_force(spark, threshold):
    rng = random.Random(5)
    templates = (("A", "a b a b c a b"), ("A", "a b c"), ("B", "a b a c c a b"), ("C", "d d d d e"), ("D", "f"), ("E", "a b c d e f g h i j"))
    texts = [" ".join(rng.choice("aabbcdefgz") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [" ".join(w for w in f"x {t} {u} y".split() if rng.random() < 0.93) for _, t in templates for _, u in templates]
    assert found_licences(spark, texts, templates=templates, threshold=threshold) == [
        brute_licences(t, templates, threshold) for t in texts]


def test_quality_tells_junk_from_prose(spark):
    import random
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{int(rng.paretovariate(0.8)) % 900}" for _ in range(60)) + "."
    data = [(i, prose() if i % 3 else " ".join(f"{w}###" for w in prose().split()), "en", "s") for i in range(900)]
    data += [d for d in rows() if d[0] is None or d[0] >= 1000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(900)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (99999, 1, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    got = quality.quality_scores(docs(spark, data), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    none = quality.quality_scores(docs(spark, data), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (jaccard.similar_documents(none), jaccard.keep_one_of_each(none), decontaminate.contained_items(none, bench),
                  decontaminate.contained_items(docs(spark), bench), mixing.mix_plan(none), mixing.mixed_documents(none),
                  sharding.shard_plan(none), passages.remove_repeats(none), lines.dedup_lines(none),
                  licenses.license_matches(none), quality.quality_scores(none, labels)):
        assert frame.count() == 0
    assert decontaminate.keep_clean(docs(spark), bench).count() == docs(spark).count()


def test_items_with_ids_of_other_types(spark):
    text = "one two three four five six seven"
    table = docs(spark, [(1, f"before {text} after", "en", "s"), (2, "nothing of it", "en", "s")])
    items = spark.createDataFrame([("a-1", text), (None, text), ("b", "absent words only here now")], "item_id string, text string")
    got = decontaminate.contained_items(table, items)
    assert dict(got.dtypes)["item_id"] == "string"
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == [(1, "a-1"), (1, None)]
    assert [r.doc_id for r in decontaminate.keep_clean(table, items).collect()] == [2]


def test_sharding_twice_keeps_every_column(spark):
    table = docs(spark).withColumn("slot", F.lit("x"))
    once = sharding.sharded_documents(table)
    twice = sharding.sharded_documents(once)
    assert twice.columns == [*table.columns, "shard_", "slot_", "shard__", "slot__"]
    assert twice.count() == table.count() and twice.where("shard_ <> shard__").count() == 0

