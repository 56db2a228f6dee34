"""Byte-level BPE, spelling groups and vector codes against the library, brute force and plain arithmetic."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tidewell.llm import byte_bpe, part_codes, queries, spelling_groups

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, vocabulary):
    flat, count = byte_bpe.encode_batch(pa.array(texts, pa.string()), vocabulary)
    return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if texts else []


def test_pieces_and_merges_are_the_librarys(vocabulary, library):
    rng = random.Random(11)
    alphabet = list(" '  \n\t\r 　abcdstremvl'LL'reSD0123½٣,.;!#é東京ß́𝒳\U0001f600‍\x1c\x85")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    assert ids_of(texts, vocabulary) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 3000, "aab" * 700, " " * 1000, "\n" * 999 + "a", "東京" * 900, "'s't're'", "a" * 257, "<|endoftext|> a", "é" * 300, "="])
def test_long_and_odd_pieces(vocabulary, library, text):
    assert ids_of([text], vocabulary) == [library.encode_ordinary(text)]


def test_random_long_pieces(vocabulary, library):
    rng = random.Random(12)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(257, 1500))) for _ in range(40)]
    assert ids_of(texts, vocabulary) == [library.encode_ordinary(t) for t in texts]


def test_a_rank_lower_than_its_parts(library):
    """Merges of a pair can make a pair of lower rank: a round over a long piece stops there."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 400, b"xab": 5, b"abx": 6, b"xabx": 401, b"aa": 399}
    own = tiktoken.Encoding("odd", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    words = byte_bpe.Vocabulary(ranks)
    rng = random.Random(13)
    for size in (9, 60, 200, 300, 900):
        text = "".join(rng.choice("abx") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        got, _ = byte_bpe.encode_pieces(data, np.array([0]), np.array([size]), words)
        assert got.tolist() == own.encode_ordinary(text)
        assert byte_bpe._merge_long(words.bytes[data], words).tolist() == own.encode_ordinary(text)


def test_texts_over_a_run_are_cut_at_pieces(vocabulary, library):
    rng = random.Random(14)
    long = "".join(rng.choice(["hello ", "world, ", "\n\n x", "東京 ", "'s ", "  "]) for _ in range(600_000))
    assert ids_of(["a", long, "b " * 9], vocabulary) == [library.encode_ordinary(t) for t in ("a", long, "b " * 9)]


def test_equal_hashes_of_different_pieces(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe.kernel, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    colliding = byte_bpe.load_vocabulary(PATH)  # a hash of the length alone
    text = "the cat sat on the mat 123 ok"
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.array([0, *(i for i, c in enumerate(text) if c == " ")])
    one, which = byte_bpe._distinct(data, starts, np.diff(np.append(starts, len(data))))
    sizes = np.diff(np.append(starts, len(data)))
    assert all(text[starts[p] : starts[p] + sizes[p]] == text[starts[one[w]] : starts[one[w]] + sizes[one[w]]] for p, w in enumerate(which))
    assert colliding.whole_pieces(data, starts, sizes).tolist().count(byte_bpe._NONE) >= len(starts) - len(set(sizes))


def test_encode_and_decode_rows(spark, vocabulary, library):
    texts = ["hello world", None, "", "hello world", "東京 isn't ‍\n\n", "x" * 70_000]
    rows = spark.createDataFrame([(None if i == 4 else i % 3, t, "ids", 1.5) for i, t in enumerate(texts)], "doc_id int, text string, ids string, n_tokens double")
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(rows, PATH), vocabulary).collect()
    assert [(r.doc_id, r.n_tokens) for r in out] == [(None if i == 4 else i % 3, len(library.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for t in texts]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in out] == [library.encode_ordinary(t or "") for t in texts]
    assert byte_bpe.encode_texts(rows.where("false"), vocabulary).collect() == []


def test_ids_without_token(spark, vocabulary):
    rows = spark.createDataFrame([(bytes([255, 255, 255, 0]),)], "ids binary")
    with pytest.raises(Exception, match="an id has no token"):
        byte_bpe.decode_ids(rows, vocabulary).collect()
    assert bytes(byte_bpe.decode_ids(spark.createDataFrame([(None,)], "ids binary"), vocabulary).first().decoded) == b""
    with pytest.raises(ValueError, match="no token for the bytes"):
        byte_bpe.Vocabulary({b"a": 0})


def test_op11_is_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def plain_count(rows, every=None, least=6, n=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and code % every == 0:
                word = word[: code % len(word)] + word[code % len(word) + 1 :]
            found[word] += 1
    return {w: c for w, c in found.items() if len(w) >= least and c >= n}


def plain_groups(words, ratio=5):
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def grouped(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def test_word_counts(spark):
    rng = random.Random(21)
    vocabulary = ["École", "naïve", "straße", "ABCDEF", "ÀÉÎõøÿ", "a×b÷cd", "common", "comon", "x" * 3000, "l'heure", "abc1def", "日本語abcdefg"]
    rows = [(i % 30 or None, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(200)] + [(1, None), (2, "")]
    table = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for every in (None, 7):
        got = spelling_groups.count_words(table, typo_every=every)
        assert {r.word: r.n for r in got.collect()} == plain_count(rows, every)
    assert spelling_groups.count_words(table.where("false")).collect() == []


def test_long_texts_are_counted_in_runs(spark):
    rng = random.Random(22)
    text = " ".join(rng.choice(["première", "deuxième", "third,thing", "ÀÀÀÀÀÀ"]) for _ in range(400_000))
    table = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling_groups.count_words(table, typo_every=199).collect()} == plain_count([(7, text)], 199)


@pytest.mark.parametrize("bound", [1 << 20, 256])
def test_groups_are_those_of_brute_force(spark, bound):
    """Many edits, ties, chains and letters of both alphabets; 256 bytes of filter take many passes."""
    rng = random.Random(23)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 7, 8]))): rng.choice([5, 5, 6, 30, 30, 200, 2000]) for _ in range(400)}
    words |= {"z" * n: 5**k for n, k in ((80, 3), (81, 2), (63, 4), (64, 3), (65, 2))} | {"ÿ" * 6: 9, "À" + "ÿ" * 5: 50}
    table = spark.createDataFrame([*words.items()], "word string, n long")
    assert grouped(spelling_groups.group_spellings(table, filter_bytes=bound)) == plain_groups(words)


def test_chain_to_the_root(spark):
    words = {"aaaaaa": 10_000, "aaaaab": 2_000, "aaaabb": 400, "aaabbb": 80, "aabbbb": 16, "zzzzzz": 5}
    got = grouped(spelling_groups.group_spellings(spark.createDataFrame([*words.items()], "word string, n long")))
    assert got["aabbbb"] == ("aaabbb", "aaaaaa", 16, 1, 80) and got["zzzzzz"] == (None, "zzzzzz", 5, 0, None)
    assert got == plain_groups(words)
    assert grouped(spelling_groups.group_spellings(spark.createDataFrame([], "word string, n long"))) == {}


def test_filters_hold_every_word(spark):
    """A Bloom filter may say yes too often, never no."""
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600)]
    places = spelling_groups._Places({8: 0, 7: len(set(words))}, spelling_groups.BITS)
    rows = list(spelling_groups._filter_rows(places)([pa.record_batch({"word": pa.array(sorted(set(words)))})]))
    blocks = np.zeros(places.total, dtype=np.uint64)
    for batch in rows:
        np.bitwise_or.at(blocks, batch["block"].to_numpy(), batch["bits"].to_numpy().view(np.uint64))
    for batch in rows:
        bits = batch["bits"].to_numpy().view(np.uint64)
        assert (blocks[batch["block"].to_numpy()] & bits == bits).all()


def plain_codes(rows, parts=part_codes.PARTS, entries=part_codes.ENTRIES, rounds=part_codes.ROUNDS):
    """(vec_id, label, code, error, label error) rows and codebooks, in Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(part_codes.SCALE * x) for x in v], label) for i, v, label in kept]
    whole = [(i, v + [0] * (-len(v) % parts), label) for i, v, label in whole]
    size = len(whole[0][1]) // parts
    cut = [(i, [v[p * size : (p + 1) * size] for p in range(parts)], label) for i, v, label in whole]
    first = {}
    for i, v, _ in sorted((x for x in cut if x[0] is not None), key=lambda x: (x[0], x[1])):
        first.setdefault(i, v)
    books = [[list(v[p]) for v in [*first.values()][:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v, _ in cut:
            for p in range(parts):
                own[p, nearest(p, v[p])[1]].append(v[p])
        for (p, e), members in own.items():
            books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out, sums = [], Counter()
    for i, v, label in cut:
        found = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        sums[label] += out[-1][3]
    return [(*r, sums[r[1]]) for r in out], books


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "code", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int")


def coded(spark, table, **options):
    model = part_codes.fit_codebooks(table)
    out = part_codes.with_label_error(part_codes.compress_vectors(table, model), **options)
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in out.collect()), key=repr), model[1].tolist()


@pytest.mark.parametrize("dims", [64, 16, 10])
def test_codes_are_those_of_plain_arithmetic(spark, monkeypatch, dims):
    """Copies, ties, shared prefixes, repeated and null ids, null labels, and vectors that can't be coded."""
    monkeypatch.setattr(part_codes, "LEAVES", 7)  # many steps of the walk
    rng = random.Random(dims)
    rows = [(rng.choice([None, i, i, i // 2]), [rng.choice([-0.5, 0.25, 0.0, 1.0, rng.uniform(-1, 1)]) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(500 + i, rows[3][1], 1) for i in range(60)]
    rows += [(-1, None, 1), (-2, [math.nan] * dims, 1), (-3, [math.inf] * dims, 1), (-4, [None] * dims, 1), (-5, [], None)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, books = plain_codes(rows)
    assert coded(spark, vectors(spark, rows)) == (sorted(want, key=repr), books)


def test_few_and_no_vectors(spark):
    assert coded(spark, vectors(spark, [])) == ([], [[]] * part_codes.PARTS)
    assert coded(spark, vectors(spark, [(None, [1.0] * 8, 1)]))[0] == []
    rows = [(2, [0.5] * 8, None), (1, [0.25] * 8, None), (3, [1e30] + [0.0] * 7, 4), (4, [1.0] * 16, 4)]
    got, books = coded(spark, vectors(spark, rows))
    assert [r[0] for r in got] == [1, 2, 3] and len(books[0]) == 3  # another length has no code, a huge component counts as the largest
    assert got[0][2:] == ("00" * 8, 0, 0) and got[2][3] == 0


def test_label_sums_by_shuffle(spark, monkeypatch):
    rows = [(i, [float(np.float32(math.sin(i * d))) for d in range(8)], i % 5 or None) for i in range(80)]
    want = coded(spark, vectors(spark, rows))
    monkeypatch.setattr(part_codes, "bounded", part_codes.durable)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert coded(spark, vectors(spark, rows), salts=3) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_walk_shares_prefixes():
    rng = np.random.default_rng(5)
    own = rng.integers(-2, 3, (4000, 6))
    own[:, 0] = rng.integers(0, part_codes.PARTS, len(own))
    parts, weight, which = part_codes._distinct(own, np.ones(len(own), dtype=np.int64))
    assert weight.sum() == len(own) and (parts[which] == own).all()
    books = rng.integers(-2, 3, (part_codes.PARTS, 16, 5))
    for leaves, entry, apart in part_codes.trie_walk(parts, books):
        every = ((parts[leaves][:, None, 1:] - books[parts[leaves][:, 0]]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()
