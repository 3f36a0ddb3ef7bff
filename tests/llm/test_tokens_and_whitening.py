"""Operators 11 to 13 against brute force: whole texts through the libraries, exact integers with numpy."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from orgpulse.llm import alignment, frames, whitening
from orgpulse.llm.vocab import byte_level_bytes, piece_bytes, vocabulary
from tests.llm.fixtures import docs, rows

A_FILE, B_FILE, WORDS_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"
SF = "/root/testdata/sf0.001"

#: White space of all kinds, control strings, marks, and what one vocabulary or the other writes differently.
AWKWARD = [
    "a", " ", "  ", " a", "a ", "a  b", "a   b  ", "a\n b", "a \nb", "a\t b\n\n c", "\n", "a  b", "a  b", "a　 b  c",
    "it's we'll I'd 're x 's", "<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y</s> <s> <unk>", "<0x41> <0x20>",
    "sign ▁ here", "▁", "é ́x ü", "\U0001f600 \U0001f469‍\U0001f4bb tail", "\x00 nul \x00", "\x1c a \x1f b",
    "123 4567 89,0", "!!! ??? ...", "İstanbul ΣΣ ẞ", "ÀÉÞß×÷ Ünder ÉTÉ éTé", "CafÉ, CAFÉ! café\u0301 N\u0303", "w" * 3000, "ab " * 4000, "한국어 日本語", "tab\tend \r\n x",
]


def _table(spark, more=()):
    data = [(5000 + k, t, "en", "s0") for k, t in enumerate(AWKWARD)]
    return rows() + data + [(5000, "other text, same id", "en", "s1"), (7, AWKWARD[12], "en", "s0")] + list(more)


def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_buffer(vocabulary(A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=vocabulary(B_FILE))


def brute_alignment(texts):
    """Per text (n_a, n_b, groups as text, links); all zero where the bytes differ."""
    a, b = _libraries()
    a_name = {i: t for t, i in a.get_vocab().items()}
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        said_a = [byte_level_bytes(a_name[i]) for i in ids_a]
        said_b = [piece_bytes(b.id_to_piece(i)) for i in ids_b]
        if not text or not b"".join(said_a) == b"".join(said_b) == b" " + text.encode():
            out.append((0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]), np.cumsum([len(x) for x in said_b])
        groups, low = [], 0
        for high in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if low < e <= high) + "|"
                          + ",".join(str(i) for i, e in zip(ids_b, ends_b) if low < e <= high))
            low = high
        place = {e: i for i, e in zip(ids_b, ends_b)}
        out.append((len(ids_a), len(ids_b), ";".join(groups), [(i, place[e]) for i, e in zip(ids_a, ends_a) if e in place]))
    return out


def test_alignment_against_whole_texts(spark):
    data = [r for r in _table(spark) if r[1] is None or len(r[1]) < 20000]
    table = docs(spark, data)
    found = alignment.align(table, vocabulary(A_FILE), vocabulary(B_FILE))
    got = alignment.aligned_documents(table, found).collect()
    brute = brute_alignment([t for _, t, *_ in data])
    count = Counter(link for *_, links in brute for link in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    expected = Counter(
        (d[0], n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == best[x[1]] for x in links),
         sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for d, (n_a, n_b, groups, links) in zip(data, brute))
    assert Counter(tuple(r) for r in got) == expected
    pairs = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(found).collect()}
    assert pairs == {k: (n, n == best[k[1]]) for k, n in count.items()}
    assert sum(1 for n_a, *_ in brute if not n_a) == 5 and any(n_a > len(links) for n_a, _, _, links in brute)


def test_alignment_of_an_empty_table_and_of_other_bytes(spark):
    table = docs(spark, [(1, "good text", "en", "s")]).selectExpr("*", "1 as digest", "2 as copies", "'x' as links")
    bad = table.selectExpr("doc_id + 1 as doc_id", "cast(unhex('61C328') as string) as text")
    both = table.select("doc_id", "text").union(bad).union(table.selectExpr("doc_id + 2", "''"))
    found = alignment.align(both, vocabulary(A_FILE), vocabulary(B_FILE))
    got = {r.doc_id: r for r in alignment.aligned_documents(both, found).collect()}
    assert got[1].n_a > 0 and got[2][1:] == got[3][1:] == (0, 0, 0, 0, 0, 0, "")
    found = alignment.align(table.where("false"), vocabulary(A_FILE), vocabulary(B_FILE))
    assert alignment.aligned_documents(table.where("false"), found).collect() == []
    assert alignment.pair_counts(found).collect() == []


def test_query_11_on_its_table(spark):
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    from orgpulse.llm.queries import op11_tokenizer_alignment
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    brute = dict(zip(given, brute_alignment(list(given.values()))))
    got = op11_tokenizer_alignment(spark, SF).collect()
    assert len(got) == len(given)
    for r in got:
        n_a, n_b, groups, links = brute[r.doc_id]
        assert (r.n_a, r.n_b, r.n_links) == (n_a, n_b, len(links))
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def _encoded(texts):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_buffer(vocabulary(WORDS_FILE))
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_token_files_against_whole_texts(spark, tmp_path):
    data = _table(spark)
    path = f"file://{tmp_path}/tokens"
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "part-000000-lost.zst").write_bytes(b"of a lost task")
    table = docs(spark, data).selectExpr("*", "1 as place", "'x' as file", "2 as start")
    frames.write_token_files(table, path, vocabulary(WORDS_FILE))
    got = frames.read_documents(spark, path).collect()
    coded = _encoded([t for _, t, *_ in data])
    expected = Counter((d[0], np.array(c, "<u4").tobytes()) for d, c in zip(data, coded))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == expected
    got.sort(key=lambda r: r.start)
    at = 0
    for before, r in zip([None, *got], got):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        assert before is None or before.doc_id is None or (r.doc_id is not None and before.doc_id <= r.doc_id)
        at += r.n_tokens
    assert not (tmp_path / "tokens" / "part-000000-lost.zst").exists()


def test_reading_some_documents_leaves_the_other_frames_alone(spark, tmp_path):
    data = [(i, f"text number {i} " * (i % 7 + 1), "en", "s") for i in range(40)] + [(None, "of nobody", "en", "s"), (7, "twice", "en", "s")]
    path = f"file://{tmp_path}/tokens"
    frames.write_token_files(docs(spark, data).repartition(3), path, vocabulary(WORDS_FILE), width=4)
    wanted = [3, 7, None, 39, 1000]
    expected = Counter((d[0], np.array(c, "<u4").tobytes()) for d, c in zip(data, _encoded([t for _, t, *_ in data])) if d[0] in wanted)
    read = lambda ids=None: Counter((r.doc_id, bytes(r.ids)) for r in frames.read_documents(spark, path, ids).collect())
    assert read(wanted) == expected and sum(read([3, 7]).values()) == 3 and not read([1000]) and not read([])
    for f in (tmp_path / "tokens").glob("*.zst"):  # damage every frame that was not asked for
        held = bytearray(f.read_bytes())
        with open(f, "rb") as opened:
            import pyarrow as pa
            file = frames.FrameFile(pa.PythonFile(opened), f.name)
            for k, name in enumerate(file.doc_ids.to_pylist()):
                if name not in wanted:
                    held[file.offsets[k + 1] + 6] ^= 0xFF
        f.write_bytes(held)
    assert read(wanted) == expected
    with pytest.raises(Exception, match="damaged|not what was written"):
        read([4])


def test_frames_are_plain_zstandard(tmp_path, spark):
    import io

    import zstandard
    path = f"file://{tmp_path}/tokens"
    frames.write_token_files(docs(spark, [(1, "one", "en", "s"), (2, "two words", "en", "s")]).coalesce(1), path, vocabulary(WORDS_FILE))
    held = b"".join(f.read_bytes() for f in sorted((tmp_path / "tokens").glob("*.zst")))
    said = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(held), read_across_frames=True).read()
    assert np.frombuffer(said, "<u2").tolist() == sum(_encoded(["one", "two words"]), [])
    frames.write_token_files(docs(spark, []), f"file://{tmp_path}/none", vocabulary(WORDS_FILE))
    assert frames.read_documents(spark, f"file://{tmp_path}/none").collect() == []


def test_query_12_on_its_table(spark):
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    from orgpulse.llm.queries import op12_token_frames
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at, expected = 0, {}
    for i, c in zip(sorted(given), _encoded([given[i] for i in sorted(given)])):
        expected[i] = (at, len(c), zlib.crc32(np.array(c, "<u4").tobytes()))
        at += len(c)
    assert {r.doc_id: tuple(r)[1:] for r in op12_token_frames(spark, SF).collect()} == expected


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        *(T.StructField(c, T.StringType()) for c in ("n", "i", "total", "component", "length"))])


def _vectors(spark, data):
    return spark.createDataFrame([(i, v, *"xxxxx") for i, v in data], VECTORS).repartition(3)


def check_whitening(got, data, scale=1024, offset=100_000, components=8):
    """``got`` rows against exact integers and eigh, for vectors of one length."""
    kept = [(i, v) for i, v in data if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(scale * c) + offset for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    centred = [[n * row[k] - s[k] for k in range(d)] for row in x]
    cov = np.array([[sum(r[i] * r[j] for r in centred) / n ** 3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    by_id = defaultdict(list)
    for r in got:
        by_id[r.component].append(r)
    assert sorted(by_id) == list(range(1, min(components, d) + 1))
    for k, rows_ in by_id.items():
        dev = Counter((i, sum(v * v for v in c)) for (i, _), c in zip(kept, centred))
        assert Counter((r.vec_id, int(r.deviation)) for r in rows_) == dev and {r.n for r in rows_} == {n}
        assert all(abs(r.explained - values[k - 1] / np.trace(cov)) <= 1e-4 * r.explained for r in rows_)
        want = np.array(centred, float) / n @ vectors[:, k - 1] / values[k - 1] ** 0.5
        order = sorted(range(n), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, want[j]))
        have = {}
        for r in rows_:
            have.setdefault(r.vec_id, []).append(r.whitened)
        sign = 1
        for j in order:
            if abs(want[j]) > 0.5:
                sign = 1 if min(abs(w - want[j]) for w in have[kept[j][0]]) < min(abs(w + want[j]) for w in have[kept[j][0]]) else -1
                break
        assert all(min(abs(w - sign * want[j]) for w in have[kept[j][0]]) < 1e-6 for j in range(n))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("size", [0.1, 3.0e6])
def test_whitening_against_exact_integers(spark, size):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 10)) * size * np.arange(1, 11)
    base[:, 3] = base[:, 0] * 0.5 + base[:, 3]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    data += [(None, data[0][1]), (3, data[3][1]), (3, data[4][1]), (900, None), (901, []), (902, [1.0, None] + [0.0] * 8),
             (903, [float("nan")] + [0.0] * 9), (904, [float("inf")] + [0.0] * 9), (905, [0.0] * 10)]
    vectors = _vectors(spark, data)
    fits = whitening.fit_whitening(vectors)
    check_whitening(whitening.whiten(vectors, fits).collect(), data)
    (fit,) = fits.values()
    x = np.floor(np.array([v for _, v in data if v and None not in v and np.isfinite(v).all()]) * 1024)
    assert np.allclose(fit.covariance(), np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9 * size ** 2)


def test_whitening_of_few_and_equal_and_unequal_vectors(spark):
    one = _vectors(spark, [(1, [1.0, 2.0])])
    got = whitening.whiten(one, whitening.fit_whitening(one)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got, key=lambda r: r.component)] == \
        [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = _vectors(spark, [(k, [float(k), 5.0, -2.0 * k]) for k in range(6)])  # one direction only
    got = whitening.whiten(flat, whitening.fit_whitening(flat)).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in got) and got[0].identity_error < 1e-9
    mixed = [(k, [float(k % 5), float(k % 3)]) for k in range(15)] + [(100 + k, [float(k % 4)]) for k in range(9)]
    both = _vectors(spark, mixed)
    got = whitening.whiten(both, whitening.fit_whitening(both)).collect()
    check_whitening([r for r in got if r.vec_id < 100], mixed[:15])
    check_whitening([r for r in got if r.vec_id >= 100], mixed[15:])
    none = both.where("false")
    assert whitening.whiten(none, whitening.fit_whitening(none)).collect() == []


def test_query_13_on_its_table(spark):
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    from orgpulse.llm.queries import op13_embedding_whitening
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(op13_embedding_whitening(spark, SF).collect(), data)
