"""Each corpus operator against brute force on small fixtures, and on the odd inputs that its docstring defines."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import held_out_secrets

from codeloom.llm import fingerprints, language_id, line_dedup, near_dedup, packing, pieces, quality, secrets, suffix_dedup, topk
from codeloom.llm.entries import MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, share, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), int(share * len(words))):
        words[i] = "x" + words[i]
    return " ".join(words)


def docs(spark, rows):
    """rows: (id, text); extra columns carry names that the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    return df.select("*", *(F.lit(9).alias(c) for c in ("key", "n", "h", "pos", "line", "same", "start", "bin", "score", "id", "t", "doc", "words", "label", "bucket")))


def empty(spark):
    return spark.createDataFrame([], DOCS)


LONG = " ".join(f"w{i % 4000}x{i}" for i in range(30_000))


def odd(spark):
    return docs(spark, [(1, "one line\nand two"), (1, "one line\nand two"), (2, None), (None, "no id"), (3, ""), (4, "   \n \n"), (5, LONG), (6, "é中😀 ▁ \x00 tab\t"), (None, None)])


# line dedup


def brute_lines(rows, most):
    norm = lambda x: " ".join(x.split()).lower()
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(norm(x), set()).add(i)
    out = []
    for i, t in rows:
        kept = None if t is None else [x for x in t.split("\n") if not norm(x) or len(seen[norm(x)]) <= most]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("entries", [100, 0])
def test_line_dedup(spark, entries):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(["Common  line", "common line ", "Rare", "", "x" * (i % 5), f"own {i}"]) for _ in range(r.randint(0, 6)))) for i in range(40)] + [(40, None), (3, "Rare"), (41, "")]
    got = line_dedup.line_dedup(docs(spark, rows), max_docs=6, broadcast_entries=entries)
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()], key=key) == sorted(brute_lines(rows, 6), key=key)
    assert got.columns == [*docs(spark, rows).columns, "n_lines", "n_dropped"]


def test_line_dedup_counts_copies_once_if_told(spark):
    rows = [(i, "a\nb\nc") for i in range(5)] + [(i, f"a\n{prose(30, i)}") for i in range(5, 8)]
    for copies, most, dropped in ((True, 4, [3] * 5 + [1] * 3), (False, 4, [0] * 8), (False, 3, [1] * 8)):
        want = dropped if copies is False else [3] * 5 + [1] * 3
        got = {x.doc_id: x.n_dropped for x in line_dedup.line_dedup(docs(spark, rows), max_docs=most, copies_count=copies).collect()}
        assert [got[i] for i in range(8)] == want


def test_line_dedup_odd(spark):
    got = line_dedup.line_dedup(odd(spark), max_docs=1).select("doc_id", "text", "n_lines").collect()
    assert len(got) == 9 and sum(x.text is None for x in got) == 2
    assert line_dedup.line_dedup(empty(spark)).collect() == []
    clash = odd(spark).select('*', *(F.lit(7).alias(c) for c in ('N_LINES', '__lines', '__hashes', '__gone', '__key', '__set', 'a.b')))
    for entries in (100, 0):
        again = line_dedup.line_dedup(clash, max_docs=1, broadcast_entries=entries)
        assert again.columns == [*(c for c in clash.columns if c != 'N_LINES'), 'n_lines', 'n_dropped']
        assert sorted(x.text or '' for x in again.collect()) == sorted(x.text or '' for x in got) and {x['__key'] for x in again.collect()} == {7}


# packing


def brute_best_fit(sizes, capacity):
    room = []
    for s in sizes:
        fit = [i for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return room


def test_best_fit_is_best_fit():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 40) for _ in range(r.randint(0, 80))]
        bins = packing.best_fit(np.array(sizes, np.int64), 40)
        room = [40 - x for x in np.bincount(bins, sizes).astype(int)] if sizes else []
        assert sorted(room) == sorted(brute_best_fit(sizes, 40))


@pytest.mark.parametrize("per_part", [50_000, 20])
def test_packing(spark, per_part):
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 250), i)) for i in range(300)] + [(7, prose(20, 1))] * 2
    got = packing.pack(docs(spark, rows), capacity=100, items_per_part=per_part).collect()
    bins = {}
    for x in got:
        bins.setdefault(x.bin_id, []).append(x)
    assert max(sum(x.length for x in b) for b in bins.values()) <= 100
    assert all(sorted(x.slot for x in b) == list(range(1, len(b) + 1)) for b in bins.values())
    want = sorted((i, s, min(100, len(t.split()) - s)) for i, t in rows for s in range(0, len(t.split()), 100))
    assert sorted((x.doc_id, x.start, x.length) for x in got) == want
    total = sum(x.length for x in got)
    assert len(bins) <= 1.12 * -(-total // 100) + 1
    again = packing.pack(docs(spark, rows), capacity=100, items_per_part=per_part).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_packing_odd(spark):
    got = packing.pack(odd(spark), capacity=2048).collect()
    assert sum(x.length for x in got if x.doc_id == 5) == 30_000
    assert {x.doc_id for x in got} == {1, 5, 6, None}
    assert packing.pack(empty(spark)).collect() == []


# quality


def junk(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice(VOCABULARY)} |" if r.random() < 0.5 else (r.choice(VOCABULARY) + " ") * 9 for _ in range(n))


def test_quality(spark):
    rows = [(i, prose(80, i) + "." if i % 3 else junk(30, i)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs(spark, rows), labels)
    got = quality.classify(docs(spark, rows), forest).collect()
    held = [x for x in got if x.doc_id >= 400]
    assert len(got) == 600 and np.mean([x.keep == (x.doc_id % 3 > 0) for x in held]) > 0.98
    assert quality.keep_good(docs(spark, rows), forest).columns == docs(spark, rows).columns


def test_trees_walk_as_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    f = quality.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20, depth=3)
    for row, s in zip(x[:50], f.scores(x[:50])):
        total = f.base
        for t in range(20):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(row[f.feature[t, k]] > f.threshold[t, k])
            total += f.leaf[t, k - 7]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9
    assert np.mean((f.scores(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)) > 0.8


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = quality.fit(odd(spark), none)
    assert len(quality.keep_good(odd(spark), forest).collect()) == 9
    assert quality.classify(empty(spark), forest).collect() == []
    rows = [(i, prose(80, i) + "." if i % 3 else junk(30, i)) for i in range(300)]
    fitted = quality.fit(docs(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int"))
    got = quality.classify(odd(spark), fitted).collect()
    assert len(got) == 9 and fitted.cut > 0
    for x in got:
        text = {r.doc_id: r.text for r in odd(spark).collect() if r.doc_id == x.doc_id and x.doc_id is not None}.get(x.doc_id, "") if x.doc_id is not None else None
        if x.doc_id is not None:
            assert abs(x.score - fitted.scores(quality.statistics(text)[None])[0]) < 1e-9 and x.keep == (x.score >= fitted.cut)
    assert len({x.score for x in got if x.doc_id in (2, 3, 4)}) == 1  # null, empty and blank
    assert len(quality.keep_good(odd(spark), fitted).collect()) == sum(x.keep for x in got)
    assert (quality.statistics(None) == 0).all() and (quality.statistics(" \n") == 0).all()


# pieces


def test_pieces_agree_with_the_library():
    import sentencepiece

    sp, e = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Encoder(pieces.Pieces(MODEL), 0.0)
    for t in ["", " ", "  a  b ", "\n\n x\n y", "é中😀\t\r\n", "Hello world, it's fine.", "x" * 300, " " * 40, prose(200, 3), LONG[:5000]]:
        assert e.encode(t).tolist() == sp.encode(t)


def test_dropout_is_seeded_varied_and_lossless(spark):
    rows = [(i, prose(60, i % 3)) for i in range(12)]
    p = pieces.Pieces(MODEL)
    one, two = pieces.Encoder(p, 0.3, seed=1), pieces.Encoder(p, 0.3, seed=2)
    cuts = {tuple(one.encode(rows[0][1], k).tolist()) for k in range(8)}
    assert len(cuts) > 4 and tuple(two.encode(rows[0][1], 0).tolist()) not in cuts
    got = pieces.encode(docs(spark, rows), MODEL, drop=0.3).collect()
    assert all(x.lossless and x.n_ids == len(x.ids) for x in got)
    r = random.Random(1)
    for _ in range(300):
        s, k = ["▁", *(r.choice("abtheoning") for _ in range(r.randrange(1, 47)))], r.getrandbits(64)
        assert p._short(list(s), int(0.3 * 2**64), k) == p._long(list(s), int(0.3 * 2**64), k)


def test_skipped_merges_are_those_of_the_hash():
    p = pieces.Pieces(MODEL)
    assert p.merge(" the", 1.0, 3) == [p.ids[c] for c in "▁the"]
    assert p.merge(" the", 0.0, 3) == [p.ids["▁the"]]


def test_each_occurrence_has_its_own_skips():
    p = pieces.Pieces(MODEL)
    e = pieces.Encoder(p, 0.1)
    got = e.encode_many([" ".join(["token"] * 4000)] * 2, [7, 8])
    for ids, doc_key in zip(got, (7, 8)):
        cuts = [p.merge(" token", 0.1, k) for k in e.keys(4000, doc_key).tolist()]
        assert ids.tolist() == [i for x in cuts for i in x]
        assert len({tuple(x) for x in cuts}) > 10
    pair = next(x for x in p.ids if len(x) == 2 and x.isalpha())
    whole = sum(p.merge(pair, 0.1, k) == [p.ids[pair]] for k in e.keys(20_000, 3).tolist())
    assert 0.89 < whole / 20_000 < 0.91
    texts = [prose(300, i) + " " + "x" * 70 + " é中😀 ▁,\n" for i in range(6)]
    small = pieces.Encoder(p, 0.3, most=50)
    for k, (t, ids) in enumerate(zip(texts, pieces.Encoder(p, 0.3).encode_many(texts, [0, 1, 2, 3, 4, 5]))):
        assert ids.tolist() == small.encode(t, k).tolist() == [i for u, x in zip(p.units(t), small.keys(len(p.units(t)), k).tolist()) for i in p.merge(u, 0.3, x)]


def test_units_met_once_are_merged_once():
    p, done, r = pieces.Pieces(MODEL), [], random.Random(4)
    replay = p.replay
    p.replay = lambda units, *a, **k: done.extend(units) or replay(units, *a, **k)
    words = sorted({"".join(r.choice("abtheoning") for _ in range(r.randrange(4, 15))) for _ in range(3000)})
    e = pieces.Encoder(p, 0.3)
    once = e.encode(" ".join(words), 1)
    assert len(done) == len(words)
    assert once.tolist() == [i for w, k in zip(words, e.keys(len(words), 1).tolist()) for i in p.merge(" " + w, 0.3, k)]
    plain = pieces.Encoder(p, 0.0, most=4000)
    plain.encode_many([" ".join(words[:500])] * 2, [1, 2])
    plain.encode_many([" ".join("".join(r.choice("rstuvwxyz") for _ in range(12)) for _ in range(3600))], [3])  # met once: forgotten, and no others
    done.clear()
    plain.encode_many([" ".join(words[:500])], [4])
    assert not done and len(plain.ways.names) == 500


def test_pairs_lossless_and_units_are_those_of_the_plain_ways():
    import numpy as np

    p, r = pieces.Pieces(MODEL), random.Random(5)
    pairs = {(p.ids[w[:k]], p.ids[w[k:]]): n for w, n in p.ranks.items() for k in range(1, len(w)) if w[:k] in p.ids and w[k:] in p.ids}
    a, b = np.array(list(pairs), np.int32).T
    assert (p._look(a, b) >> pieces._PLACE).tolist() == list(pairs.values())
    assert (p._look(b, a) == pieces._NO_PAIR).tolist() == [x[::-1] not in pairs for x in pairs]
    assert (p._look(np.full(3, -1, np.int32), np.array([-1, 0, 5], np.int32)) == pieces._NO_PAIR).all()
    texts = ["".join(r.choice(["a", "the", " ", "  ", "\n", "\0", "é", "▁", "中", "x" * 25]) for _ in range(r.randrange(9))) for _ in range(2000)]
    assert [p.units(t) for t in texts] == [pieces._UNITS_AND_LINES.findall(" " + t) for t in texts]
    ids = pieces.Encoder(p, 0.3).encode_many(texts, list(range(2000)))
    assert p.lossless(texts, ids) == [p.decode(x.tolist()) == t for t, x in zip(texts, ids)] == [True] * 2000
    assert p.lossless(["the", None, "", "a b"], [ids[0][:0], ids[0][:0], ids[0][:0], pieces.Encoder(p, 0.0).encode("a c")]) == [False, None, True, False]


def test_pieces_odd(spark):
    got = pieces.encode(odd(spark), MODEL)
    assert [x.lossless for x in got.collect() if x.ids is not None] == [True] * 7 and got.where("ids is null and n_ids is null").count() == 2
    back = pieces.decode(got, MODEL).collect()
    assert sorted(x.text or "" for x in back) == sorted(x.text or "" for x in odd(spark).collect())
    assert pieces.encode(empty(spark), MODEL).collect() == []


# language


def test_language(spark):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "der die das und nicht ist", "cc": "el la los que por una"}
    r = random.Random(5)
    text = lambda l: " ".join(r.choice(words[l].split()) for _ in range(25))
    rows = [(i, text(l := ("aa", "bb", "cc")[i % 3]), l) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 150"))
    got = {x.doc_id: x.lang for x in language_id.identify(df, model).collect()}
    assert all(got[i] == l for i, _, l in rows)


def brute_bucket(gram, bits):
    """The hash of an n-gram, one character at a time, in whole numbers."""
    factors, full = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (1 << 64) - 1
    h = sum(ord(c) * f for c, f in zip(gram, factors)) & full
    x = (h + len(gram)) * factors[0] & full
    return ((x ^ x >> 29) * factors[1] & full) >> (64 - bits)


def brute_bayes(texts, langs, bits, smooth):
    names = sorted(set(langs))
    counts = {n: [smooth] * 2**bits for n in names}
    for t, l in zip(texts, langs):
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                counts[l][brute_bucket(t[i : i + n].lower(), bits)] += 1
    return lambda t: {l: np.log((langs.count(l) + 1) / (len(langs) + len(names))) + sum(np.log(counts[l][brute_bucket(t[i : i + n].lower(), bits)] / sum(counts[l])) for n in (1, 2, 3) for i in range(len(t) - n + 1)) for l in names}


def test_language_scores_are_those_of_brute_force(spark):
    texts, langs = ["abab", "Cdcd é", "xyz xyz", "cd"], ["x", "y", "y", "x"]
    want = brute_bayes(texts, langs, 8, 0.1)
    some = ["abc", "", "dcdc" * 50, "a", "é中😀", "ab\ncd"]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, langs))] + [(9, None, "x"), (10, "", "y"), (11, "zzz", None)], "doc_id long, text string, lang string")
    for m in (language_id.train(texts, langs, bits=8), language_id.fit(df, bits=8)):
        assert m.languages == ["x", "y"] and np.allclose(m.scores(some), [list(want(t).values()) for t in some], atol=1e-4)
    got = language_id.identify(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), m).collect()
    for r in got:
        s = sorted(want(some[r.doc_id]).items(), key=lambda x: (-x[1], x[0]))
        assert (r.lang, r.margin) == (None, None) if not some[r.doc_id] else r.lang == s[0][0] and abs(r.margin - (s[0][1] - s[1][1]) / len(some[r.doc_id])) < 1e-4


def test_language_ties_go_to_the_first_by_name(spark):
    m = language_id.train(["abc", "abc"], ["q", "p"], bits=8)
    got = language_id.identify(spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "zz")], "doc_id long, text string"), m).collect()
    assert {(r.lang, r.margin) for r in got} == {("p", 0.0)} and len(got) == 3


def test_language_odd(spark):
    model = language_id.fit(odd(spark))
    got = language_id.identify(odd(spark), model).collect()
    assert len(got) == 9 and sum(x.lang is None for x in got) == 3
    assert language_id.identify(empty(spark), language_id.fit(empty(spark))).collect() == []
    assert {x.lang for x in language_id.identify(odd(spark), language_id.fit(empty(spark))).collect()} == {None}


# fingerprints


def test_fingerprints(spark):
    rows = [(i, prose(60, i // 3)) for i in range(60)] + [(60, None), (61, ""), (0, prose(60, 0))]
    one = fingerprints.i_match(docs(spark, rows), low=0.5, high=6)
    other = fingerprints.i_match(docs(spark, rows), low=0.5, high=6, broadcast_entries=0)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
    by = {x.doc_id: x for x in one.collect()}
    assert by[3].fp0 == by[4].fp0 != by[9].fp0 and by[60].fp0 is None and by[61].n_terms == 0
    assert len({by[3].fp0, by[3].fp1, by[3].fp2}) == 3


def test_fingerprints_odd(spark):
    for entries in (10**6, 0):
        got = fingerprints.i_match(odd(spark), low=0.0, high=9.0, broadcast_entries=entries).collect()
        words = {r.doc_id: {w.encode().lower() for w in (r.text or "").split()} for r in odd(spark).collect() if r.doc_id is not None}
        assert len(got) == 9 and all(x.n_terms == len(words[x.doc_id]) for x in got if x.doc_id is not None)
        assert sorted(x.n_terms for x in got if x.doc_id is None) == [0, 2] and len({x.fp0 for x in got if x.doc_id == 1}) == 1
        assert all((x.fp0 is None) == (x.n_terms == 0) for x in got)
        assert fingerprints.i_match(empty(spark), broadcast_entries=entries).collect() == []


# secrets


def crf_of_prose(seed=1):
    cut = [x for i in range(200) for x in secrets.cut_windows(prose(200, i), i)]
    return secrets.train(secrets.examples(cut, seed, most=2000))


@pytest.mark.parametrize("lines", [held_out_secrets.LINES, held_out_secrets.UNSEEN])
def test_secrets_written_by_hand(lines):
    """The examination isn't made by what makes the training examples."""
    crf, right, wrong, missed = crf_of_prose(), [], [], []
    texts, keys = zip(*held_out_secrets.cases(lines))
    for text, want, found in zip(texts, keys, secrets.spans(crf, list(texts))):
        got = [text[b:e] for b, e in found]
        right += [x for x in got if x in want]
        wrong += [x for x in got if x not in want]
        missed += [x for x in want if x not in got]
    print("wrong:", wrong, "missed:", missed)
    assert len(right) / (len(right) + len(wrong)) >= 0.75 and len(right) / (len(right) + len(missed)) >= 0.75


def test_windows_hold_no_keys_and_come_from_whole_texts():
    text = " ".join(f"w{chr(97 + i % 26)}" if i != 700 else "Zx81kq00ab27pd91" for i in range(30_000))
    cut = [w for s in range(400) for w, n in secrets.cut_windows(text, s) if n == 30_000]
    assert len(cut) > 600 and all(len(w) == 10 and "Zx81kq00ab27pd91" not in w for w in cut)


def test_spans_hold_the_whole_secret():
    jwt, password = f"eyJ{'hbGciOiJIUzI1NiIs' + 'abc'}.eyJ{'zdWIiOiIxMjM0NTY3' * 3}.{'SflKxwRJSMeKKF2Q-_' * 2}", "p@ss.w!rd$1x9"
    words = {jwt: jwt, f'"{jwt}",': jwt, "secret_access_key=abc123def4567": "abc123def4567", f'password="{password}"###': password, f"token:'{password}'": password, f"'{password}';": password,
             'config["api_key"]="a1.b2"': "a1.b2", "key=Zm9v+/YmFy==": "Zm9v+/YmFy==", "p!ss=w@rd9": "p!ss=w@rd9", "AKIA1234:x9.y": "AKIA1234:x9.y", "====": "===="}

    class Tagger:
        def decode(self, docs):
            return [[(1, 2)] for _ in docs]

    for word, want in words.items():
        text = f"é {word} end"
        assert [text[b:e] for b, e in secrets.spans(Tagger(), [text])[0]] == [want]


def test_viterbi_is_the_best_path():
    crf = secrets.train(secrets.examples(secrets.cut_windows(prose(100, 1), 1), 1, most=300), epochs=2)
    r = random.Random(4)
    for _ in range(25):
        words = [r.choice(["token", "=", "the", '"04dbebab91ab85687d33eeaaf9ac699e1188f962"', "-----BEGIN", "Qx7" * 8, "KEY-----"]) for _ in range(r.randint(1, 6))]
        shape = [tuple(secrets.attributes(w)) for w in words]
        table = lambda a, role: sum((crf.weights[f] for f in secrets._features(a, role) if f in crf.weights), np.zeros(3))
        odd_share = sum(map(secrets._is_odd, shape)) / len(words)
        emit = [table(a, "own") + (table(shape[i - 1], "prev") if i else 0) + (table(shape[i - 2], "prev2") if i > 1 else 0) + (table(shape[i + 1], "next") if i + 1 < len(words) else 0) + crf.files[secrets.file_class(len(words), odd_share)] for i, a in enumerate(shape)]
        best = max(itertools.product(range(3), repeat=len(words)), key=lambda p: sum(e[t] for e, t in zip(emit, p)) + sum(crf.moves[a, b] for a, b in zip((0, *p), (*p, 0))))
        want = [i for i, t in enumerate(best) if t]
        assert [i for b, e in crf.decode([words])[0] for i in range(b, e)] == want


def test_secrets_in_tables(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, prose(150, i)) for i in range(60)] + [(100, f'{prose(40, 1)} token = "{key}" {prose(4000, 2)} "{key}"'), (100, f'x token = "{key}"')]
    df = docs(spark, rows)
    crf = secrets.fit(df)
    found = secrets.scan(df, crf).collect()
    assert [x.doc_id for x in found] == [100] * 3
    clean = {t for (t,) in secrets.mask_secrets(df, crf).select("text").collect()}
    assert not any(key in t for t in clean) and f'x token = "{secrets.MASK}"' in clean and prose(150, 5) in clean


def test_secrets_odd(spark):
    crf = secrets.fit(odd(spark))
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    masked = secrets.mask_secrets(odd(spark), crf).collect()
    assert sorted(repr(x.text) for x in masked) == sorted(repr(x.text) for x in odd(spark).collect())
    assert secrets.scan(odd(spark), crf).collect() == [] and secrets.mask_secrets(empty(spark), crf).collect() == []
    assert secrets.scan(empty(spark), secrets.fit(empty(spark))).collect() == []
    found = docs(spark, [(None, f'é {LONG} token = "{key}" {LONG}')] * 2)
    start = len(LONG) + 12
    assert [tuple(x)[:3] for x in secrets.scan(found, crf).collect()] == [(None, start, start + 40)] * 2
    assert all(key not in x.text and x.n_chars == len(x.text) for x in secrets.mask_secrets(found, crf).collect())


# near-duplicates


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def brute_groups(rows, least):
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = (rows[i][1] or "").split(), (rows[j][1] or "").split()
        if a and b and distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9:
            label = [label[i] if x == label[j] else x for x in label]
    return label


def test_alignment():
    r, pairs = random.Random(1), []
    for _ in range(300):
        a = [r.randrange(6 if r.random() < 0.3 else 500) for _ in range(r.randrange(0, 70))]
        b = list(a)
        for _ in range(r.randrange(0, 16)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.randrange(500)] * r.randrange(2)
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    for least in (0.85, 0.6, 0.95):
        assert near_dedup.edit_close(pairs, least).tolist() == [distance(a, b) <= np.floor((1 - least) * max(len(a), len(b)) + 1e-9) for a, b in pairs]


def test_near_duplicates(spark):
    rows = [(i, prose(60, i)) for i in range(40)]
    rows += [(100 + i, edited(prose(60, i), 0.05, i)) for i in range(15)] + [(200 + i, prose(60, i)) for i in range(5)] + [(0, prose(60, 0)), (300, None), (301, ""), (302, "")]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    want = brute_groups(rows, 0.85)
    groups = {}
    for x in got:
        groups.setdefault(x.group_id, []).append(x)
    assert all(sum(x.keep for x in g) == 1 for g in groups.values())
    by_label = {}
    for (i, _), l in zip(rows, want):
        by_label.setdefault(l, []).append(i)
    assert sorted(sorted(x.doc_id for x in g) for g in groups.values()) == sorted(sorted(g) for g in by_label.values() if len(g) > 1)
    kept = near_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == len(set(want))


def test_near_duplicate_recall(spark):
    r = random.Random(9)
    rows = []
    for i in range(120):
        base = prose(r.randint(20, 120), 1000 + i)
        rows += [(2 * i, base), (2 * i + 1, edited(base, r.choice((0.02, 0.05, 0.1)), i))]
    got = {x.doc_id for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    true = [i for i in range(0, 240, 2) if distance(rows[i][1].split(), rows[i + 1][1].split()) <= 0.15 * max(len(rows[i][1].split()), len(rows[i + 1][1].split()))]
    assert np.mean([i in got for i in true]) >= 0.9 and len(true) > 100


@pytest.mark.parametrize("words", [(7, 20), (20, 60)])
def test_recall_of_short_texts_and_at_the_bound(spark, words):
    """As many words are changed as the bound allows, all over the text."""
    r, rows = random.Random(19), []
    for i in range(150):
        base = prose(r.randint(*words), 5000 + i).split()
        changed = list(base)
        for at in r.sample(range(len(base)), int(0.15 * len(base) + 1e-9)):
            changed[at] = f"q{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed))]
    got = {x.doc_id for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert np.mean([2 * i in got for i in range(150)]) >= 0.9


def test_buckets_of_unlike_documents_are_searched_in_full(spark):
    shared = prose(14, 1)
    rows = [(i, f"{shared} {edited(prose(6, i % 4), 0.2, i)}") for i in range(24)]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    want = brute_groups(rows, 0.85)
    assert len({x.group_id for x in got}) == len({l for l in want if want.count(l) > 1})


def test_near_odd(spark):
    assert {(x.doc_id, x.keep) for x in near_dedup.near_duplicates(odd(spark)).collect()} == {(1, True), (1, False)}
    clash = odd(spark).select("*", *(F.lit(7).alias(c) for c in ("__key", "__slot", "__nth", "__KEEP", "a.b", "marks")))
    kept = near_dedup.keep_one(clash)
    assert kept.dtypes == clash.dtypes and len(kept.collect()) == 8 and {x["__key"] for x in kept.collect()} == {7}
    assert near_dedup.near_duplicates(empty(spark)).collect() == near_dedup.keep_one(empty(spark)).collect() == []
    assert len(near_dedup.keep_one(docs(spark, [(None, None)] * 3 + [(None, LONG)] * 3)).collect()) == 4


# suffix array


def brute_passages(rows, least):
    seen = {}
    texts = {(i, t) for i, t in rows if t}
    for i, t in texts:
        w = t.split()
        for s in range(len(w) - least + 1):
            seen.setdefault(tuple(w[s : s + least]), []).append((i, t, s))
    out = []
    for i, t in texts:
        w, hit = t.split(), []
        for s in range(len(w) - least + 1):
            if len(seen[tuple(w[s : s + least])]) > 1:
                if hit and s <= hit[-1][1]:
                    hit[-1][1] = s + least
                else:
                    hit.append([s, s + least])
        out += [(i, a, b - a) for a, b in hit]
    return sorted(out)


@pytest.mark.parametrize("per, hot_at", [(30_000, 100_000), (15, 1_000_000), (30_000, 128)])
def test_repeated_passages(spark, per, hot_at, monkeypatch):
    if hot_at == 128:  # nearly all contexts go the way of those that are too frequent for one task
        monkeypatch.setattr(suffix_dedup, "SAMPLED", 2)
        hot_at = 2
    r = random.Random(6)
    parts = [prose(r.randint(5, 40), 50 + i) for i in range(12)] + ["do re mi " * 12, "la " * 40]
    rows = [(i, " ".join(r.choice(parts) if r.random() < 0.6 else prose(r.randint(1, 20), 1000 * i + k) for k in range(r.randint(0, 9)))) for i in range(40)] + [(3, "do re mi " * 20), (77, None), (78, "")]
    got = suffix_dedup.repeated_passages(docs(spark, rows), least=20, per_collection=per, hot_at=hot_at).collect()
    assert sorted((x.doc_id, x.start, x.length) for x in got) == brute_passages(rows, 20)


@pytest.mark.parametrize("chunk", [1, 3, 1 << 18])
def test_collection_bwt(tmp_path, chunk):
    """With chunk 1 or 3 the collection is far larger than what is held of its files."""
    r = random.Random(4)
    for _ in range(25):
        texts = [[r.randrange(3) for _ in range(r.randrange(0, 12))] for _ in range(r.randrange(1, 9))]
        lengths = np.array([len(t) for t in texts])
        symbols = np.full((len(texts), max(1, lengths.max())), -1, np.int32)
        for i, t in enumerate(texts):
            symbols[i, : len(t)] = t[::-1]
        parts = list(suffix_dedup.collection_bwt(symbols, lengths, f"file://{tmp_path}", chunk, 0 if chunk == 1 else 20))
        assert max(len(p[0]) for p in parts) <= chunk
        doc, size, lcp = (np.concatenate(x) for x in zip(*parts))
        want = sorted(((t[len(t) - k :], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1)), key=lambda z: [(x + 1, 0) for x in z[0]] + [(0, z[1])])
        common = [0] + [next((n for n, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(want, want[1:])]
        assert [(i, k) for _, i, k in want] == list(zip(doc.tolist(), size.tolist())) and lcp.tolist() == common
    assert not list(tmp_path.iterdir())


def test_repeated_passages_odd(spark):
    assert suffix_dedup.repeated_passages(odd(spark)).collect() == suffix_dedup.repeated_passages(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(odd(spark), least=40_000)
    wide = docs(spark, [(1, LONG), (2, 'a b ' + ' '.join(LONG.split()[500:1100])), (3, prose(700, 1))])
    assert {(x.doc_id, x.start, x.length) for x in suffix_dedup.repeated_passages(wide, least=300).collect()} == {(1, 500, 600), (2, 2, 600)}
    both = docs(spark, [(1, LONG), (2, "start " + LONG), (None, LONG)])
    assert sorted((x.doc_id or 0, x.start, x.length) for x in suffix_dedup.repeated_passages(both).collect()) == [(0, 0, 30_000), (1, 0, 30_000), (2, 1, 30_000)]


# top-k


@pytest.mark.parametrize("per_block", [None, 37])
@pytest.mark.parametrize("every", [1, 20])
def test_top_k(spark, per_block, every):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 24)) for c in range(4)]).round(3)
    x[5] = x[6] = x[7] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1.0, 2.0]), (501, [1.0, 2.5]), (502, None), (503, []), (504, [float("nan")] * 24), (505, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in ("block", "v", "id", "query", "dims", "code", "grp", "rank")))
    got = sorted((r.vec_id, r["rank"], r.neighbour, r.distance) for r in topk.top_k(df, None if every == 1 else df.where(f"vec_id % {every} = 0"), k=5, per_block=per_block).collect())
    want = [(i, 1, 1001 - i, 0.5) for i in (500, 501) if i % every == 0]
    for i in range(0, len(x), every):
        d = ((x[i] - x) ** 2).sum(1)
        near = sorted((s, j) for j, s in enumerate(d) if j != i)[:5]
        want += [(i, k + 1, j, round(float(np.sqrt(s)), 6)) for k, (s, j) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)


def test_every_level_is_tried_on_all_pairs_that_are_left():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 64))[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    q, d, tally = topk.Block(x[:100], list(range(100))), topk.Block(x, list(range(3000))), np.zeros(4, np.int64)
    topk.nearest(q, d, np.full(100, np.inf), 10, tally=tally)
    assert tally[0] == 100 * 2999 and tally[1] >= tally[2] >= tally[3] >= 1000 and tally[3] < 0.1 * tally[0]


def test_bounds_are_lower_bounds():
    x = np.random.default_rng(2).normal(size=(50, 30))
    true = ((x[:, None] - x[None]) ** 2).sum(2)
    last = np.zeros_like(true)
    for s in (1, 3, 6, 15, 30):
        y = topk.segment_statistics(x, s)
        bound = ((y[:, None] - y[None]) ** 2).sum(2)
        assert (bound <= true + 1e-9).all() and (bound >= last - 1e-9).all()
        last = bound


def test_top_k_odd(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    few = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (None, [3.0]), (2, [0.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(none).collect() == topk.top_k(few, none).collect() == topk.top_k(none, few).collect() == []
    got = sorted((r.vec_id or 0, r["rank"], r.neighbour or 0, r.distance) for r in topk.top_k(few).collect())
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 2, 3.0), (1, 1, 2, 0.0), (1, 1, 2, 0.0), (1, 2, 0, 3.0), (1, 2, 0, 3.0), (2, 1, 1, 0.0), (2, 2, 1, 0.0), (2, 3, 0, 3.0)]
    names = spark.createDataFrame([("a", [0.0, 1.0]), (None, [0.0, 2.0]), ("b", [1.0] * 3)], "vec_id string, embedding array<double>")
    assert {(r.vec_id, r.neighbour) for r in topk.top_k(names).collect()} == {("a", None), (None, "a")}
