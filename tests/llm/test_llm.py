"""Neighbours, encoding, packing and language labels against brute force, exact round trips and held-out cases."""

import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from factweave.llm import encoding, language, neighbours, packing
from factweave.llm.bpe import Encoder, Vocabulary

TOKENIZER = f"{encoding.TOKENIZERS}/byte_bpe_50k"


def tiktoken_of(name):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=Vocabulary(f"{encoding.TOKENIZERS}/{name}.tiktoken").ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_encoding_is_exact(name):
    encode, reference = Encoder(Vocabulary(f"{encoding.TOKENIZERS}/{name}.tiktoken"), encoding.PATTERN), tiktoken_of(name)
    r = random.Random(1)
    alphabets = ["ab", "aAbB '", "éèü ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "。日本語 ", "\n\t  x", "ABC-_=/.,", "👨‍👩‍👧 ", "'s're've"]
    texts = ["", " ", "\n\n", "a" * 50_000, " " * 3000, "<|endoftext|>", "it's 12:30\r\n\r\n-->", *("".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(60))) for _ in range(3000))]
    texts += ["".join(r.choice(alphabets[i % len(alphabets)]) for _ in range(r.randrange(1, 40))) for i in range(4000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<i4").tolist() == reference.encode_ordinary(t), t[:80]


def test_known_pieces_are_bounded(monkeypatch):
    from factweave.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    encode, reference = Encoder(Vocabulary(f"{TOKENIZER}.tiktoken"), encoding.PATTERN), tiktoken_of("byte_bpe_50k")
    for i in range(50):
        t = f"word{i} other{i} 77{i}"
        assert np.frombuffer(encode(t), "<i4").tolist() == reference.encode_ordinary(t) and len(encode.known) < 20


def test_encode_table(spark):
    data = [(1, "Hello there"), (1, "Hello there"), (None, "x"), (2, None), (3, ""), (4, "long text. " * 200_000)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "doc_id bigint, text string, ids string, key int")
    got = {(r.doc_id, len(r.ids)): r.ids for r in encoding.encode(df, "doc_id", "text").collect()}
    reference = tiktoken_of("byte_bpe_50k")
    assert sorted(k[0] or 0 for k in got) == [0, 1, 2, 3, 4] and got[(2, 0)] == got[(3, 0)] == []
    assert encoding.encode(df, "doc_id", "text").count() == 6
    assert [v for k, v in got.items() if k[0] == 4][0] == reference.encode_ordinary(data[-1][1])
    assert encoding.encode(df.limit(0), "doc_id", "text").collect() == []


def test_best_fit():
    r = random.Random(2)
    for capacity in (1, 7, 512):
        sizes = [r.randrange(1, capacity + 1) for _ in range(400)]
        bins = packing.best_fit(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) <= 11 / 9 * -(-sum(sizes) // capacity) + 4
    assert packing.best_fit([], 5) == []


@pytest.mark.parametrize("per_task", [5, 200_000])
def test_packing(spark, per_task):
    r = random.Random(3)
    data = [(i, " word" * r.choice([1, 2, 3, 5, 8, 13, 30, 31, 32, 33, 100])) for i in range(300)] + [(7, " word" * 5), (None, " word"), (900, None), (901, "")]
    df = spark.createDataFrame([(*x, "clash", 5) for x in data], "doc_id bigint, text string, container string, tokens int").repartition(5)
    got = packing.pack(df, "doc_id", "text", {"a": 32, "b": 1000, "none": 0}, per_task=per_task).collect()
    for kind, capacity, slack in (("a", 32, 1.12), ("b", 1000, 1.12)):
        own = [x for x in got if x.bin_kind == kind]
        filled = {}
        for x in own:
            filled[x.container] = filled.get(x.container, 0) + x.tokens
        assert max(filled.values()) <= capacity
        by = {}
        for x in own:
            by.setdefault(x.doc_id, []).append((x.token_from, x.tokens))
        for i, text in data:
            if i is not None and i != 7 and text:
                n = text.count("word")
                parts = sorted(by[i])
                assert sum(t for _, t in parts) == n and [f for f, _ in parts] == [sum(t for _, t in parts[:j]) for j in range(len(parts))]
                assert n > capacity or len(parts) == 1
        assert sum(t for _, t in by[None]) == 1 and 900 not in by and 901 not in by
        total = sum(text.count("word") for _, text in data if text)
        assert sum(filled.values()) == total
        if per_task > 5:
            assert len(filled) <= slack * total / capacity + 2
    assert len({x.container for x in got if x.bin_kind == "a"} & {x.container for x in got if x.bin_kind == "b"}) == 0
    assert packing.pack(df.limit(0), "doc_id", "text", {"a": 32}).count() == 0


def brute(live, k):
    """(vec_id, other) of the k nearest within the limit, equal distances by id."""
    out = set()
    scopes = {}
    for e, s, i, v, cosine, limit in live:
        scopes.setdefault((e, s), []).append((i, np.array(v, np.float64), cosine, limit))
    for key, own in scopes.items():
        for i, v, cosine, limit in own:
            near = []
            for j, w, _, _ in own:
                if i != j and limit is not None:
                    d = 1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w) if cosine else np.linalg.norm(v - w)
                    if d <= limit:
                        near.append((0.0 if np.array_equal(v, w) else d, j))
            out |= {(*key, i, j) for _, j in sorted(near)[:k]}
    return out


LIVE = "entity_id string, scope_name string, vec_id string, v array<float>, cosine boolean, near_limit double"


def clustered(n, dim, seed, cosine, limit, copies=0):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n - 8, 12):  # groups of near vectors
        x[i + 1 : i + 8] = x[i] + 0.05 * g.standard_normal((7, dim))
    if copies:
        x[-copies:] = x[-1]
    return [("t", f"s{seed}", f"v{i:05d}", x[i].tolist(), cosine, limit) for i in range(n)]


@pytest.mark.parametrize("cosine,limit", [(True, 0.05), (False, 0.9), (True, float("inf")), (False, float("inf"))])
def test_neighbours_against_brute_force(spark, cosine, limit):
    live = clustered(500, 48, 1, cosine, limit) + clustered(60, 48, 2, cosine, limit) + clustered(3, 5, 3, cosine, None)
    got = neighbours.nearest(spark.createDataFrame(live, LIVE), 5, cell_rows=60)
    want = brute(live, 5)
    found = {(r.entity_id, r.scope_name, r.vec_id, r.other) for r in got.collect()}
    assert len(found & want) >= 0.99 * len(want) and len(found - want) <= 0.01 * len(want) + 2 * (limit == float("inf")) * len(want) * 0.01


@pytest.mark.parametrize("limit", [0.05, float("inf")])
def test_neighbours_over_many_cells(spark, limit):
    """20,000 vectors in 256 cells; in groups, as the nearest of a vector far from all others are anyone's."""
    g = np.random.default_rng(8)
    x = (np.repeat(g.standard_normal((1667, 64)), 12, axis=0)[:20_000] + 0.08 * g.standard_normal((20_000, 64))).astype(np.float32)
    live = spark.createDataFrame([("t", "s", f"v{i:05d}", x[i].tolist(), True, limit) for i in range(len(x))], LIVE)
    got = {}
    for r in neighbours.nearest(live, 5, cell_rows=80, block_rows=50).collect():
        got.setdefault(r.vec_id, set()).add(int(r.other[1:]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, len(x), 20)
    d = 1 - u[asked] @ u.T
    d[np.arange(len(asked)), asked] = 9
    want = {int(i): set(np.argsort(d[j])[:5][np.sort(d[j])[:5] <= limit].tolist()) for j, i in enumerate(asked)}
    assert sum(len(got.get(f"v{i:05d}", set()) & w) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("scope,dim", [("harbor-east/photo_tags", 64), ("rental-pool/notes", 96)])
@pytest.mark.parametrize("depth", [8, 12])
def test_few_cells_are_visited(scope, dim, depth):
    import duckdb

    entity, name = scope.split("/")
    rows_ = duckdb.sql(f"select v from '/root/testdata/sf0.01/vec_data.parquet' where op = 'put' and entity_id = '{entity}' and scope_name = '{name}' and len(v) = {dim} and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0").fetchall()
    x = np.unique(np.array([r[0] for r in rows_], np.float32), axis=0)
    p = neighbours._scaled(x[np.abs(x).sum(1) > 0], True) @ neighbours.projection(dim)
    tree = neighbours.build_tree(p, depth)
    cell = neighbours.home_cells(tree, p)
    low, high = np.full((1 << depth, p.shape[1]), np.inf), np.full((1 << depth, p.shape[1]), -np.inf)
    np.minimum.at(low, cell, p)
    np.maximum.at(high, cell, p)
    most = neighbours.chi_square_bound(neighbours.PROJECTIONS, neighbours.CELL_SURE) / neighbours.APPROXIMATION**2 * 2 * 0.06
    row, near = neighbours.cells_near(tree, (low, high), p, np.full(len(p), most))
    assert len(row) <= 0.05 * len(p) * (1 << depth) and set(zip(range(len(p)), cell.tolist())) <= set(zip(row.tolist(), near.tolist()))
    few = neighbours.cells_near(tree, (low, high), p, np.full(len(p), most), rows_held=50)
    assert (few[0] == row).all() and (few[1] == near).all()


def test_a_third_of_equal_vectors(spark):
    live = clustered(240, 16, 4, True, 0.2, copies=80)
    got = neighbours.nearest(spark.createDataFrame(live, LIVE), 5, cell_rows=50).collect()
    assert {(r.entity_id, r.scope_name, r.vec_id, r.other) for r in got} == brute(live, 5)
    assert max(np.unique([r.vec_id for r in got], return_counts=True)[1]) <= 5


def test_small_groups_of_equal_vectors(spark):
    live = clustered(60, 16, 5, False, 3.0)
    live += [("t", "s5", f"w{i}", live[0][3], False, 3.0) for i in range(3)] + [("t", "s5", f"x{i}", live[1][3], False, 3.0) for i in range(5)]
    got = neighbours.nearest(spark.createDataFrame(live, LIVE), 5).collect()
    assert {(r.entity_id, r.scope_name, r.vec_id, r.other) for r in got} == brute(live, 5)


WRITE = "row_no bigint, entity_id string, scope_name string, vec_id string, v array<float>, op string, dim string, metric string"


def test_live_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [
        (1, "t", "c", "a", [1.0, 0.0], "put"), (2, "t", "c", "a", None, "put"), (3, "t", "c", "a", [1.0], "put"), (4, "t", "c", "a", [1.0, nan], "put"), (5, "t", "c", "a", [inf, 1.0], "put"), (6, "t", "c", "a", [None, 1.0], "put"),
        (7, "t", "c", "b", [0.0, 1.0], "put"), (8, "t", "c", "b", None, "delete"), (9, "t", "c", "z", [0.0, 0.0], "put"), (10, "t", "e", "z", [0.0, 0.0], "put"), (11, "t", "none", "a", [1.0, 1.0], "put"),
        (12, "t", "c", "d", [1.0, 1.0], "put"), (14, "t", "c", "d", [2.0, 1.0], "put"), (13, "t", "c", "d", None, "delete"), (None, "t", "c", "d", None, "delete"), (15, None, "c", "a", [1.0, 0.0], "put"), (16, "t", "c", None, [1.0, 0.0], "put"), (17, "t", "c", "a", None, "other"), (1, "t", "c", "a", [1.0, 0.0], "put"),
    ]
    registry = spark.createDataFrame([("t", "c", 2, None, 0.1, "x"), ("t", "e", 2, "euclidean", 0.1, "x")], "entity_id string, scope_name string, dim int, metric string, near_limit double, v string")
    live = neighbours.live_vectors(spark.createDataFrame([(*x, "x", "y") for x in data], WRITE), registry)
    assert rows(live.select("scope_name", "vec_id", "v")) == [("c", "a", [1.0, 0.0]), ("c", "d", [2.0, 1.0]), ("e", "z", [0.0, 0.0])]
    nothing = spark.createDataFrame([], WRITE)
    assert neighbours.near_pairs(neighbours.live_vectors(nothing, registry)).count() == 0


def test_chi_square_bound():
    for m, p, want in ((1, 0.95, 3.841), (4, 0.99, 13.277), (24, 0.999, 51.179)):
        assert abs(neighbours.chi_square_bound(m, p) - want) < 0.01


SENTENCES = {
    "en": ["Where did you put the lantern?", "I can hear the wind better than you.", "There is no train before tomorrow.", "My brother works at the bakery.", "Why are they looking at us like that?"],
    "de": ["Wo hast du die Laterne hingelegt?", "Ich höre den Wind besser als dich.", "Vor morgen früh fährt kein Zug.", "Mein Bruder arbeitet in der Bäckerei.", "Warum schauen die uns so an?"],
    "es": ["¿Dónde has puesto la linterna?", "Oigo mejor el viento que tu voz.", "No hay ningún tren hasta mañana.", "Mi hermano trabaja en la panadería.", "¿Por qué nos miran de esa manera?"],
    "ru": ["Куда ты дел старый фонарь?", "Я лучше слышу ветер, чем тебя.", "До утра поездов не будет.", "Мой брат работает в пекарне.", "Почему они так на нас смотрят?"],
}


def subtitles(languages, seed):
    r = random.Random(seed)
    return "".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{x if x not in SENTENCES else r.choice(SENTENCES[x])}\n\n" for i, x in enumerate(languages))


@pytest.fixture(scope="module")
def labelled():
    names = {"en": "English", "de": "ger", "es": "es-MX", "ru": "RU"}
    out = [(i, subtitles([c] * 12, i), names[c]) for i, c in enumerate(list(SENTENCES) * 12)]
    return out + [(100, subtitles(["de"] * 10, 100), "en"), (101, subtitles(["es"] * 10, 101), None)]


def test_languages(spark, labelled):
    de = subtitles(["de"] * 6 + ["en"] * 2 + ["de"] * 4 + ["[dog barking]", "<i></i>"], 7)
    data = [*labelled, (200, de, "de"), (201, de.encode().decode("cp1252", "ignore"), "deu"), (202, de.replace("\n", "\r\n"), "xx"), (203, None, "en"), (204, "", "en"), (205, "no cues at all", "en"), (206, subtitles(["[sighs]", "www.subs.example"], 1), "xx"), (207, "1\n00:01 --> 00:02\nMy brother works at the bakery." + " My brother works." * 50_000, None), (None, de, "de")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "doc_id bigint, text string, lang string, confidence string, cue_pos int")
    got = language.languages(df)
    found = {(r.doc_id, r.cue_pos): (r.lang, r.differs) for r in got.collect()}
    for i, c in enumerate(list(SENTENCES) * 12):
        assert found[(i, 0)] == (c, False), i
    assert found[(100, 0)] == ("de", True) and found[(101, 0)] == ("es", True) and found[(207, 0)] == ("en", True)
    for i, differs in ((200, False), (201, False), (202, True), (None, False)):
        assert {k[1]: v for k, v in found.items() if k[0] == i} == {0: ("de", differs), 7: ("en", True), 8: ("en", True)}
    assert not any(k[0] in (203, 204, 205, 206) for k in found)
    assert all(0 <= r.confidence <= 1 for r in got.collect())
    assert language.languages(df.limit(0)).count() == 0


def test_far_from_every_centroid(spark, labelled):
    model = language.fit([(label, text) for _, text, label in labelled])
    classify = language.Classifier(model)
    [(positions, scores, votes)] = classify([language.cue_words("1\n0:01 --> 0:02\nqwzx xzwq vbkj\n\n2\n0:03 --> 0:04\n...")])
    assert positions.tolist() == [1] and language.decide(positions, scores, votes, model.usual)[0] == -1
    assert language.fit([("xx", "1\n0 --> 1\nHello")]) is None


def test_labels():
    for label, want in {"en": "en", "EN-gb": "en", "fre": "fr", "Portuguese": "pt", "pt_BR": "pt", " spa ": "es", "xx": None, "": None, None: None, "unknown": None, "-": None, "fi": None, "Brazilian Portuguese": "pt"}.items():
        assert language.label_language(label) == want, label


def test_repair():
    for text in ("Ça va déjà où?", "Где ты был?", "Żółć", "plain", "É só um Â"):
        once = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in once.encode())
        assert language.repair(text) == text and language.repair(once) == text and language.repair(twice) == text


def test_held_out_accuracy(spark):
    """Labels of files that weren't fitted on; about one in twelve labels is wrong in the test data itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").isNotNull()).select("doc_id", "lang", "text").collect()
    known = [r for r in docs if language.label_language(r.lang)]
    model = language.fit([(r.lang, r.text) for r in known[::2]])
    classify = language.Classifier(model)
    test = known[1::2]
    mains = [language.decide(*x, model.usual)[0] for x in classify([language.cue_words(r.text) for r in test])]
    spoken = [(language.CODES[m], language.label_language(r.lang)) for m, r in zip(mains, test) if m >= 0]
    assert sum(a == b for a, b in spoken) / len(spoken) > 0.88


def test_adverts_go_and_speech_stays():
    cue = "1\n00:00:01,000 --> 00:00:02,000\n"
    for speech in ("Ma dimmi... io ti amo", "Ciao. io ti amo", "Estou... com fome", "Ele. com fome", "alle 3. io ti amo", "Family night? Count me in", "Get every episode of him", "Learn a language in 3 years", "time and time again"):
        assert [w for w in language.cue_words(cue + speech + "\nyes") if w.isalpha()] == [w for w in re.findall(r"[^\W\d_]+", (speech + " yes").lower())], speech
    for advert in ("see fine-subs . example now", "see subs24 .tv", "see finesubs.io", "Timed & translated by Ann", "Sync and corrections: x", "Subtitles by Ann", "Please rate this file"):
        assert [w for w in language.cue_words(cue + advert + "\nyes") if w.isalpha()] == ["yes"], advert
