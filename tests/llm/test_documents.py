"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import jaccard, licences, lines, mixing, pieces, quality, token_counts
from tests.llm.helpers import WORDS, documents, empty, frame, words


def key(x):
    return tuple((v is None, v) for v in x)


# --- quality rules


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


def test_quality_counts(spark):
    rows = documents() + [(500, "a b c a b c x " * 20, "en", "a", 1, "x", 7, "y", 1.5), (501, "# * <>\n# * <>\n", "en", "a", 1, "x", 7, "y", 1.5)]
    got = quality.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], *brute_quality(r[1])) for r in rows), key=key)
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got), key=key) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert g.kept == (not g.broken_rules and not g.base_failed)
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(g.doc_id for g in got if g.kept)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_rules_tell_junk(spark):
    rnd = random.Random(1)
    good = [" ".join(rnd.choice(["the", "of", "and", "stone", "water"]) + str(rnd.randrange(10**6)) * (rnd.random() < 0.7) for _ in range(80)) for _ in range(10)]
    junk = [" | ".join(g.split()) for g in good] + [" ".join(f"{w}!!" for w in g.upper().split()) for g in good] + [("red blue the " * 40)]
    rows = [(i, t, "en", "a", 1, "x", 7, "y", 1.5) for i, t in enumerate(good + junk)]
    kept = {g.doc_id for g in quality.judge(frame(spark, rows)).filter("kept").collect()}
    assert kept == set(range(10))


# --- n-gram Jaccard join


def brute_links(rows, k, percent):
    sets, groups = {}, defaultdict(set)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[d] = s
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    del groups
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(rnd, n=12, size=120, each=6):
    out = []
    for _ in range(n):
        base = [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(rnd.choice([3, 9, 12, 20, size]))]
        for _ in range(each):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(1000))
            if rnd.random() < 0.3:
                w = w[: -rnd.randrange(1, 3)]
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words_, percent, chunk", [(3, 90, 200_000), (5, 80, 200_000), (3, 90, 150)])
def test_jaccard_equals_brute_force(spark, monkeypatch, words_, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = [(i, t) for i, t in enumerate(near_copies(random.Random(percent)))] + [(900 + i, r[1]) for i, r in enumerate(documents())]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, family string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df, words=words_, percent=percent).collect()}
    assert got == brute_links(rows, words_, percent)
    kept = {r.doc_id for r in jaccard.keep_first(df, words=words_, percent=percent).collect()}
    assert kept == {d for d, (n, c) in got.items() if n == 0 or c == d}


def test_jaccard_families_stay_near_copies(spark, monkeypatch):
    """Texts that only share passages with others never reach a family; a large family ships no more than the input at once."""
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(30) for _ in range(4)]
    shares = [" ".join(sum(([*p, *fresh(18)] for p in rnd.sample(passages, 3)), fresh(20))) for _ in range(120)]
    base = fresh(150)
    copies = []
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(len(w))] = fresh(1)[0]
        copies.append(" ".join(w))
    rows = list(enumerate(shares + copies))
    tables, ships = {}, []
    real = jaccard.table

    def table(df, name, folder=None):
        tables.setdefault(name, []).append(real(df, name, folder))
        return tables[name][-1]

    monkeypatch.setattr(jaccard, "table", table)
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    arrow = type(spark.range(1).groupBy("id")).applyInArrow
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", lambda self, f, kind: ships.append(self._df.agg({"t": "count"}).first()[0]) or arrow(self, f, kind))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df, words=5, percent=80).collect()}
    assert got == brute_links(rows, 5, 80)
    assert tables["families"][0].count() <= len(copies)
    assert len(ships) > 1 and max(ships) <= 2 * len(rows)


def test_jaccard_edges(spark):
    out = jaccard.link(frame(spark))
    assert out.count() == len(documents())
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[45].component_id == by_id[46].component_id == 0 and by_id[40].n_shingles == 0 and by_id[41].component_id == 41
    assert jaccard.link(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 40), st.sampled_from([80, 90]), st.integers(0, 10**6))
def test_linked_sets_share_a_block(size, a_only, b_only, percent, seed):
    import numpy as np

    x = jaccard.mix(np.arange(seed, seed + size + a_only + b_only, dtype=np.uint64), 9)
    a, b = np.unique(x[: size + a_only]), np.unique(np.concatenate([x[:size], x[size + a_only :]]))
    if 100 * size >= percent * (size + a_only + b_only):
        assert set(jaccard.block_keys(a, percent).tolist()) & set(jaccard.block_keys(b, percent).tolist())


@given(st.binary(max_size=200))
def test_word_hashes_follow_words(data):
    import numpy as np

    h, starts, ends = jaccard.word_hashes(np.frombuffer(data, np.uint8))
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split()
    seen = {}
    for w, x in zip(data.lower().split(), h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- line dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :] or a == b


def brute_lines(rows):
    """{doc_id: text} after removal."""
    all_lines = [(d, i, x) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\v")]
    all_lines.sort()
    gone = set()
    for n, (d, i, x) in enumerate(all_lines):
        w = x.split(" ")
        for d2, i2, y in all_lines[:n]:
            if (d2, i2) == (d, i):
                continue
            if x == y or (min(len(w), len(y.split(" "))) >= 5 and one_edit(w, y.split(" "))):
                gone.add((d, i))
                break
    return [(d, t if t is None or d is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows]


def edited_lines(seed):
    rnd = random.Random(seed)
    base = [words(rnd, rnd.choice([1, 4, 5, 6, 7, 12])) for _ in range(12)]
    out = []
    for d in range(25):
        ls = []
        for _ in range(rnd.randrange(1, 5)):
            w = rnd.choice(base).split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + ["new"] + w[at:], w[:at] + ["zz"] + w[at + 1 :]]) or ["q"]
            ls.append(" ".join(w))
        out.append((d, "\n".join(ls)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rows = edited_lines(seed) + [(100 + i, t) for i, t in enumerate(["", " \n\t\n", "\n\nred blue\n\n", "a  b c d e\na  b c d f"])] + [(200, None), (None, "red blue"), (-5, words(random.Random(3), 3000)), (1 << 40, words(random.Random(3), 3000) + " end")]
    df = spark.createDataFrame([(d, t, "q", 3) for d, t in rows], "doc_id long, text string, k string, pos int").repartition(3)
    out = lines.dedup(df, counts=True)
    assert out.columns == ["doc_id", "text", "k", "pos", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_lines_with_ids_beyond_a_long_and_repeated_rows(spark):
    rows = [(-(1 << 62), "red blue green fast slow"), ((1 << 62) + 5, "red blue green fast night\nx"), (7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup(df).collect()) == [(-(1 << 62), "red blue green fast slow"), (7, "same"), (7, "same"), ((1 << 62) + 5, "x")]
    assert lines.dedup(empty(spark)).count() == 0
    assert lines.dedup(frame(spark)).count() == len(documents())


# --- mixing


def test_mixing_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, rnd.choice([0, 3, 20, 60])), "en", rnd.choice(["s0", "s0", "s1", "s2", None]), 1, "x", 7, "y", 1.5) for i in range(600)]
    df = frame(spark, rows)
    got = mixing.digest(df).collect()
    size = defaultdict(int)
    for _, t, _, s, *_ in rows:
        size[s] += len(t.split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = dict(zip(order, [3, 1, 2, 3], strict=True))
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:  # water filling, step by step
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == size[s] and abs(g.target - target[s]) < 1e-6
        assert g.taken in (0, g.size, 2 * g.size)
        assert (g.first_position is None) == (g.taken == 0) and (g.taken == 0 or 0 <= g.first_position <= 1)
        taken[s] += g.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert sorted(map(tuple, mixing.digest(df.repartition(7)).collect()), key=key) == sorted(map(tuple, got), key=key)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({g.doc_id: g.taken // g.size for g in got if g.taken})


def test_mixing_steps_over_what_does_not_fit(spark):
    rnd = random.Random(21)
    sizes = {"a": [60] + [5] * 8, "b": [40], "c": [7, 7, 7], "d": [rnd.randrange(1, 90) for _ in range(10)], "e": [rnd.choice([3, 20, 60]) for _ in range(400)], "f": [900] + [2] * 30}
    rows, source = [], {}
    for s, zs in sizes.items():
        for z in zs:
            source[len(rows)] = s
            rows.append((len(rows), words(rnd, z), "en", s, 1, "x", 7, "y", 1.5))
    df = frame(spark, rows)
    got = sorted(mixing.digest(df, skip=True).collect())
    for s, zs in sizes.items():
        mine = [g for g in got if source[g.doc_id] == s]
        total, target = sum(g.taken for g in mine), mine[0].target
        large = [z for z in zs if z * 100 > sum(zs)]
        # per pass: half of a short document, or less than the shortest large one left out
        miss = 0
        for c in range(2):
            budget, left = min(max(target - c * sum(zs), 0), sum(zs)), []
            n = 0
            for z in sorted(large, reverse=True):
                if n + z <= budget:
                    n += z
                else:
                    left.append(z)
            short = [z for z in zs if z not in large]
            miss += max(short, default=0) / 2 if sum(short) >= budget - n else min([budget - n - sum(short), *left])
        assert abs(total - target) <= miss + 1e-6, (s, total, target, miss)
        assert all(g.taken in (0, g.size, 2 * g.size) for g in mine)
    assert sorted(mixing.digest(df.repartition(5), skip=True).collect()) == got
    mixed = mixing.mix(df, skip=True)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({g.doc_id: g.taken // g.size for g in got if g.taken})
    assert mixing.digest(empty(spark), skip=True).count() == 0
    assert len(mixing.digest(frame(spark), skip=True).collect()) == len(documents())


def test_mixing_follows_the_schedule(spark):
    rows = [(i, "a b c d", "en", f"s{i % 3}", 1, "x", 7, "y", 1.5) for i in range(900)]
    order = [r.source for r in mixing.mix(frame(spark, rows)).collect()]
    early, late = Counter(order[: len(order) // 2]), Counter(order[len(order) // 2 :])
    assert early["s0"] > late["s0"] and early["s2"] < late["s2"] and abs(early["s1"] - late["s1"]) < 30


def test_mixing_edges(spark):
    assert mixing.digest(empty(spark)).count() == 0
    got = mixing.digest(frame(spark)).collect()
    assert len(got) == len(documents())
    only_empty = [(i, None, "en", None, 1, "x", 7, "y", 1.5) for i in range(3)]
    assert [(r.size, r.target, r.taken) for r in mixing.digest(frame(spark, only_empty)).collect()] == [(0, 0.0, 0)] * 3


# --- token counts


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block, group", [(7, 3), (64, 2), (1 << 17, 1024)])
def test_token_counts(spark, bpe, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    rows = documents() + [(600, "a<|endoftext|>b", "en", "a", 1, "x", 7, "y", 1.5)]
    got = token_counts.counts(frame(spark, rows).repartition(3), block=block)
    want = sorted(((r[0], len(bpe.encode_ordinary(r[1] or ""))) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=key) == want
    assert token_counts.counts(empty(spark)).count() == 0


def test_flat_files(spark, tmp_path):
    import numpy as np

    files = {"a": [5, 6, 0, 0, 7, 8, 9, 1, 1, 0, 3, 4], "b": [0], "c": [], "d": list(range(1, 30))}
    for n, tokens in files.items():
        np.array(tokens, "<u4").tofile(tmp_path / f"{n}.bin")
    got = token_counts.scan(token_counts.read_files(spark, str(tmp_path), 8), 0, "<u4")
    out = defaultdict(list)
    for r in got.orderBy("file", F.col("block").asc_nulls_last(), "ordinal").collect():
        out[r.file[-5]].append((r.n_tokens, r.terminated))
    assert out == {"a": [(2, True), (0, True), (5, True), (2, False)], "b": [(0, True)], "d": [(29, False)]}


def test_flat_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_counts, "RANGE_BLOCKS", 2)
    monkeypatch.setattr(token_counts, "GROUP", 4)
    rnd = random.Random(3)
    want = []
    for n in ("one file", "b%20c"):
        tokens = [rnd.randrange(40) for _ in range(5000)]
        np.array(tokens, "<u2").tofile(tmp_path / f"{n}.bin")
        run = 0
        for t in tokens:
            if t == 0:
                want.append((n, run, True))
                run = 0
            else:
                run += 1
        want += [(n, run, False)] * (run > 0)
    blocks = token_counts.read_files(spark, str(tmp_path), 64)
    assert blocks.select("file", F.length("data").alias("n")).groupBy("file").agg(F.sum("n").alias("n")).select("n").collect() == [(10_000,)] * 2
    got = token_counts.scan(blocks, 0).collect()
    assert sorted((os.path.basename(r.file)[:-4], r.n_tokens, r.terminated) for r in got) == sorted(want)


# --- SentencePiece


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Model.parse(open(pieces.default_model(), "rb").read()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@settings(max_examples=400, deadline=None)
@given(t=st.text(alphabet=st.sampled_from("aehinorst  .\n▁é日😀0123ABß") | st.characters(exclude_categories=("Cs",)), max_size=80))
def test_pieces_equal_the_library(encoder, library, t):
    ids = encoder.encode(t)
    assert list(ids) == library.encode(t)
    assert encoder.decode(ids) == library.decode(list(ids))
    assert "▁" in t or encoder.decode(ids) == t


def test_unigram_viterbi_is_optimal():
    rnd = random.Random(5)
    vocabulary = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) for _ in range(12)} | {"a", "b"})
    m = pieces.Model(["<unk>", *vocabulary], [0.0] + [-rnd.random() * 5 for _ in vocabulary], [pieces.UNKNOWN] + [pieces.NORMAL] * len(vocabulary), pieces.UNIGRAM, False)
    e = pieces.Encoder(m)

    def best(t):
        return max((m.scores[m.pieces.index(t[:k])] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in vocabulary), default=0.0) if t else 0.0

    for _ in range(60):
        t = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))
        ids = e.encode(t)
        assert "".join(m.pieces[i] for i in ids) == t and abs(sum(m.scores[i] for i in ids) - best(t)) < 1e-9


def test_pieces_frame(spark, encoder, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 500)
    df = frame(spark)
    out = pieces.encode(df)
    want = sorted(((r[0], encoder.encode(r[1] or "").tolist()) for r in documents()), key=lambda x: (x[0] is None, x[0], len(x[1])))
    got = out.collect()
    assert sorted(((r.doc_id, list(r.token_ids)) for r in got), key=lambda x: (x[0] is None, x[0], len(x[1]))) == want
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in got)
    back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in documents() if r[0] is not None)
    assert pieces.encode(empty(spark)).count() == 0


# --- licences


def brute_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark):
    texts = ["Under the MIT License. under the mit-license", "x Apache  License, Version 2.0 CC BY-NC 4.0", "underthe mit license", "THE ÜBER CC-BY-NC", None, "", "under the mit license " * 3000]
    texts += ["foo bar " + licences.TEMPLATES[0][2].replace("rights", "right").title() + " tail", "This work is licensed under the GNU General Public License, version 3.", "general public license gnu version", licences.TEMPLATES[4][2]]
    rows = documents() + [(700 + i, t, "en", "a", 1, "x", 7, "y", 1.5) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows)).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute_base(r[1])
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    assert [got[700 + i].labels for i in (7, 8, 9, 10)] == ["mit", "gpl-3", "", "bsd"]
    assert all(got[i].labels == "" for i in range(len(documents()) - 2))
    assert licences.scan(empty(spark)).count() == 0


def best_share(words, template):
    """The greatest share of a template's words that stand at one offset, give or take the slack, over all offsets."""
    starts = range(-len(template), len(words))
    return max((sum(w in words[max(0, o + p) : max(0, o + p + licences.SLACK + 1)] for p, w in enumerate(template)) / len(template) for o in starts), default=0.0)


def test_licence_templates_equal_brute_force(spark):
    rnd = random.Random(12)
    known = licences.prepared(licences.TEMPLATES)
    rows, planted = [], {}
    for k, (label, _, text) in enumerate(licences.TEMPLATES):
        for changed in (0, 1, 3):
            w = text.split()
            for at in rnd.sample(range(len(w) // 2, len(w)), min(changed, len(w) // 20)):
                w[at] = "other"
            planted[len(rows)] = (label, changed, k)
            rows.append((len(rows), f"{words(rnd, 40)} {' '.join(w)} {words(rnd, 40)}", "en", "a", 1, "x", 7, "y", 1.5))
    rows += [(1000 + i, words(rnd, 300), "en", "a", 1, "x", 7, "y", 1.5) for i in range(20)]
    for r in licences.scan(frame(spark, rows)).collect():
        found = set(filter(None, r.labels.split(",")))
        w = licences.words_of(rows[r.doc_id][1]) if r.doc_id < 1000 else []
        text = f" {' '.join(w)} "
        may = {t.label for t in known if best_share(w, t.words) >= licences.MIN_SCORE and all(x in text for x in t.keys)}
        assert found <= may | set(licences.BASE.values()), (r.doc_id, found, may)
        if r.doc_id >= 1000:
            assert not found and r.score == 0
            continue
        label, changed, k = planted[r.doc_id]
        if not changed:
            assert label in found and r.score == 1.0, (label, r)
        if all(x in text for x in known[k].keys):
            assert label in found, (label, changed, r)
    siblings = licences.scan(frame(spark, [(i, t, "en", "a", 1, "x", 7, "y", 1.5) for i, t in enumerate((licences.texts.BSD_2, licences.texts.BSD_3))])).collect()
    assert [r.labels for r in sorted(siblings)] == ["bsd,bsd-2", "bsd,bsd-3"]


def test_licences_take_one_pass_over_many_base_phrases():
    import time

    w = "under the mit license".split() * 60_000
    start = time.monotonic()
    places, labels = licences._base_places(w)
    assert places == list(range(0, 240_000, 4)) and labels == {"mit"} and time.monotonic() - start < 5
    assert licences._base_places("the mit license".split()) == ([], set())


def test_licences_of_given_texts(spark):
    own = [("house", ("house rules",), "these are the house rules of this building and nobody may change any of them")]
    rows = [(1, "See: these are the House Rules of this building, and nobody may change any of them!", "en", "a", 1, "x", 7, "y", 1.5), (2, licences.texts.MIT, "en", "a", 1, "x", 7, "y", 1.5)]
    assert {r.doc_id: (r.labels, r.score) for r in licences.scan(frame(spark, rows), templates=own).collect()} == {1: ("house", 1.0), 2: ("", 0.0)}
