from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from cadenza.llm import bpe, line_dedup, ngram_join, oracles, packing, quality_rules, sharding, substring_dedup
from cadenza.llm.frames import take
from cadenza.llm.words import sliding_max, sliding_min, window_hashes, words_of
from tokenizers import Tokenizer

from .conftest import words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
count = lambda rows: collections.Counter(map(tuple, rows))


def covered(ws, repeated, n):
    flags = [False] * len(ws)
    for i in range(len(ws) - n + 1):
        if repeated(tuple(ws[i : i + n])):
            flags[i : i + n] = [True] * n
    return flags


def test_words_and_windows():
    w = words_of(["a b  c", None, "", " x\ty a b c "])
    assert w.counts.tolist() == [3, 0, 0, 5]
    assert w.hash[0] == w.hash[5] and len(set(w.hash.tolist())) == 5
    assert window_hashes(w.hash, 3)[0] == window_hashes(w.hash, 3)[5]
    # equal words have equal hashes wherever they stand, others differ: lengths around eight bytes and the long ones
    tail = [c * n + e for n in range(200) for c in "aä" for e in ("", "b")]
    many = words_of([" ".join(tail[4:]), None, "\n" + "\t".join(reversed(tail[4:]))])
    one, two = many.hash[: many.counts[0]], many.hash[many.counts[0] :][::-1]
    assert one.tolist() == two.tolist() and len(set(one.tolist())) == len(set(tail[4:]))
    x = np.random.default_rng(0).random(50)
    for k in (1, 2, 5, 18):
        assert (sliding_min(x, k) == [x[i : i + k].min() for i in range(51 - k)]).all()
        assert (sliding_max(x, k) == [x[i : i + k].max() for i in range(51 - k)]).all()


def test_quality_rules(spark, messy, none):
    got = quality_rules.quality_rules(messy)
    assert {c.lower() for c in messy.columns} <= {c.lower() for c in got.columns}
    expected = []
    for row in messy.collect():
        text, ws = row.text or "", words(row.text)
        seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        repeat = sum(covered(ws, lambda k: seen[k] > 1, 5))
        lines = [x for x in text.split("\n") if words(x)]
        expected.append((row.doc_id, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(ws) < 10 or 100 * repeat > 20 * len(ws)))
    assert count(quality_rules.digest(got).drop("kept").collect()) == count(expected)
    assert quality_rules.digest(quality_rules.quality_rules(none)).count() == 0


def test_quality_rules_verdicts(spark):
    clean = "The river runs past the old mill and on to the sea.\nNobody knew where the road would end, but all went on."
    rows = [(1, clean), (2, " | ".join(["home", "news", "shop", "help", "about"] * 4)), (3, "THE BIG SALE ENDS NOW AND HERE FOR ALL OF YOU TODAY"), (4, "the# river& runs% past* the# old& mill% and* on# to& sea%"), (5, "a menu without any sentence mark that goes on for many more words than twelve of them")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_quality_rules_know_boilerplate(spark):
    prose = "The river runs past the old mill and on to the sea.\nNobody knew where the road would end, but all went on."
    bad = ["Home\nAbout us\nOur products\nNews\nContact\nHelp\nMy basket\nLog in"]
    bad += ["This work is licensed under the GNU General Public License, version 3.\nAll rights reserved."]
    bad += ["Copyright 2019 The Example Company.\nThis site uses cookies to make your visit better.", "Please enable JavaScript to view the comments on this page.\nSign up for our weekly newsletter."]
    bad += ["Share this article on Facebook.\nRead our privacy policy and the terms of use before you go on."]
    good = [prose, prose + "\nAll rights reserved.", "A long line on how a baker came to accept cookies from a stranger, which was kind, and then to sell them at the market in the town for a year."]
    good += ["One\nTwo\n" + prose]
    docs = spark.createDataFrame(list(enumerate([*bad, *good])), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.text) for r in quality_rules.quality_rules(docs, phrases=True).collect()}
    assert [got[i][0] for i in range(len(got))] == [False] * len(bad) + [True] * len(good)
    assert all(got[i][1] == "" for i in range(len(bad)))
    assert [got[len(bad) + i][1] for i in range(4)] == [prose, prose, good[2], good[3]]


def test_quality_rules_see_last_marks_and_letters_as_the_sql(spark, tmp_path):
    many, shout = "a line of many words that goes on and on without any mark at its end", "THE BIG SALE ENDS NOW AND HERE FOR ALL OF YOU"
    bad = [many + '."\u2028', many + ".\u0085", many + "!\u2029", shout + " ON \u1fbcDES", "1 2 3 4 \u1f88 5 6 7 8 9", shout + " OF \ufb01", shout + " \u0149", shout + " \u1e96", shout + " \u019b"]
    good = [many + "\u2028.", "\ufb01 1 2 3 4 5 6 7 8 9.", "\U00010d50 1 2 3 4 5 6 7 8 9.", shout + " \u1fb3.", shout + " \u00df."]
    docs = spark.createDataFrame(list(enumerate([*bad, *good])), "doc_id long, text string")
    got = quality_rules.digest(quality_rules.quality_rules(docs)).collect()
    assert {r.doc_id: r.kept for r in got} == {i: i >= len(bad) for i in range(len(bad) + len(good))}
    docs.write.parquet(str(tmp_path / "documents"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert count(sql.execute(oracles.OP1).fetchall()) == count(tuple(r) for r in got)


# what the SQL of op1 would be with the phrase and menu rules: its text, and what comes in its place
WIDER = [
    ("SELECT r, unnest(string_split(t, chr(10))) AS x FROM d", "SELECT r, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d"),
    ("l AS (SELECT r, x,", "l AS (SELECT r, i, x,"),
    ("j AS (SELECT r, x, y,", "j AS (SELECT r, i, x, y,"),
    (
        "AS chars FROM l),",
        r"""AS chars FROM l),
     m AS (SELECT *, n <= 4 AND NOT regexp_matches(y, '[.!?:;"''…”’»)\]}]$') AS few FROM j),
     k AS (SELECT *, few AND coalesce(lag(few) OVER o AND lead(few) OVER o OR lag(few) OVER o AND lag(few, 2) OVER o
                                      OR lead(few) OVER o AND lead(few, 2) OVER o, false) AS menu FROM m WINDOW o AS (PARTITION BY r ORDER BY i)),""",
    ),
    ("AS bad FROM j)", "OR menu OR (n <= 20 AND regexp_matches(y, '(?i)" + "|".join(quality_rules.PHRASES) + "')) AS bad FROM k)"),
]


def test_quality_rules_with_phrases_match_the_wider_sql(spark, tmp_path):
    r = random.Random(7)
    lines = ["", " ", "Home", "About us", "Log in now", "One two three four", "One two three four five", "Stop.", "THE BIG SALE ENDS NOW", "a | b | c"]
    lines += ["All rights reserved.", "Licensed under the Apache License, Version 2.0.", "Released under a free licence", "We use cookies.", "This site uses cookies, as it says", "Accept all cookies"]
    lines += ["Please enable JavaScript!", "Sign up for our weekly newsletter.", "Share this on X", "Terms and conditions", "(c) 2020 us", "COPYRIGHT 1999", "all  rights reserved", "word " * 18 + "cookie policy.", "word " * 19 + "cookie policy."]
    lines += ["The river runs past the old mill and on to the sea.", "Nobody knew where the road would end, but all went on.", "a line of many words that goes on and on without any mark at its end"]
    docs = spark.createDataFrame([(i, "\n".join(r.choices(lines, k=r.randint(1, 9)))) for i in range(2000)] + [(-1, None), (-2, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    db, sql = duckdb.connect(), oracles.OP1
    for old, new in WIDER:
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    got = count(quality_rules.digest(quality_rules.quality_rules(docs, phrases=True)).collect())
    assert got == count(db.execute(sql).fetchall())
    assert (got - count(db.execute(oracles.OP1).fetchall())).total() > 100


def test_bpe_matches_the_library(spark, messy, none):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    expected = []
    for row in messy.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        expected.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert count(bpe.round_trip(messy, WORD).collect()) == count(expected)
    both = take(bpe.decode(bpe.encode(messy, WORD), WORD), "text", "decoded").collect()
    assert all(r.decoded == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in both)
    assert bpe.round_trip(none, WORD).count() == 0


def test_bpe_runs_and_forgetting():
    mine, library = bpe.WordBPE(WORD), Tokenizer.from_file(WORD)
    texts = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["&" * 30, "I'M you'LL it's 12345", "ΣΑΣ ΟΔΟΣ İ"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        mine.known = {}


def brute_classes(rows, n=5, threshold=0.8):
    sets = []
    for _, text in rows:
        ws = words(text)
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(rows[i][0], least.get(root(i)) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def test_ngram_join(spark, messy, none):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert count(ngram_join.ngram_join(messy).collect()) == count(brute_classes(rows))
    classes = {c for _, c, _ in brute_classes([r for r in rows if words(r[1])])}
    stay = ngram_join.keep_one(messy)
    assert stay.columns == messy.columns
    kept = [r.doc_id for r in stay.collect() if words(r.text)]
    assert sorted(map(str, kept)) == sorted(map(str, classes))
    assert ngram_join.ngram_join(none).count() == 0


def test_rows_without_a_word_stay(spark):
    rows = [(None, None, "en"), (None, None, "de"), (None, "", "en"), (None, "", "en"), (3, " \t\n", "en"), (3, " \t\n", "de"), (4, "one row of two", "en"), (4, "one row of two", "en")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert count(got.collect()) == count(rows[:-1])


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """A group of near copies over several blocks: counts are whole, and the classes hold."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        v = list(base)
        v[(7 * i) % 120] = f"new{i}"
        rows.append((i, " ".join(v)))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert count(got) == count(brute_classes(rows))


def test_trie_levels_meet_each_pair_once():
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 2, (40, 6)).astype(np.uint8)
    marks[:, :2] = 1  # one subtree of depth 2
    here = np.arange(40)
    levels = list(ngram_join.by_level(marks, here, here, 2, np.triu(np.ones((40, 40), bool), 1)))
    assert (sum(x.astype(int) for x in levels) == np.triu(np.ones((40, 40), int), 1)).all()
    shared = [[next((k for k in range(6) if marks[i, k] != marks[j, k]), 6) for j in range(40)] for i in range(40)]
    depth = 7
    for met in levels:
        found = {shared[i][j] for i, j in zip(*np.nonzero(met), strict=True)}
        assert max(found) < depth
        depth = min(found)
    few = np.zeros((40, 40), bool)
    few[0, 1] = True
    assert len(list(ngram_join.by_level(marks, here, here, 2, few))) == 1  # nothing open is left after it


def test_ngram_join_of_a_chain(spark):
    """Neighbours are similar, ends are not: one class, and links count neighbours alone."""
    length, step = 400, 18
    stream = [f"w{i}" for i in range(length + 60 * step)]
    rows = [(i, " ".join(stream[i * step : i * step + length])) for i in range(60)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = brute_classes(rows)
    assert {c for _, c, _ in wanted} == {0} and max(n for _, _, n in wanted) < 10
    assert count(got) == count(wanted)


def test_ngram_join_recall(spark):
    """Pairs of a similarity just above the threshold, measured against brute force."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(300):
        ws = [f"x{v}" for v in r.integers(0, 10**6, 150)]
        near = list(ws)
        for at in (20, 60, 100)[: 1 + i % 3]:
            near[at] = "changed"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(near))]
    got = {d: n for d, _, n in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {d: n for d, _, n in brute_classes(rows)}
    assert sum(wanted.values()) == 600  # all pairs are links: 3 changed words cost 15 of 146 windows on each side
    assert sum(got.values()) >= 0.999 * sum(wanted.values()) and all(got[d] <= wanted[d] for d in got)


def test_packing(spark, messy, none):
    placed = packing.pack(messy, BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    wanted = collections.Counter()
    for row in messy.collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            wanted[row.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(r)[:5] for r in placed) == wanted
    windows = collections.defaultdict(list)
    for r in placed:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in placed)
    assert len(windows) == -(-total // 2048)
    assert packing.pack(none, BYTE).count() == 0


def test_packed_sequences(spark):
    docs = spark.createDataFrame([(i, "words and more words " * (i + 1)) for i in range(12)], "doc_id long, text string")
    placed = packing.pack(docs, BYTE, capacity=64)
    got = {r.sequence_id: r.ids for r in packing.sequences(docs, placed, BYTE, capacity=64).collect()}
    lengths = {r[0]: r[1] for r in placed.groupBy("sequence_id").sum("length").collect()}
    assert {k: len(v) for k, v in got.items()} == lengths


def test_packing_plan_fills_windows():
    assert packing.fill({5: 1, 3: 2, 4: 1}, 9) in ({5: 1, 4: 1},)
    rows = packing.plan({7: 1000, 3: 10, 2048: 5, 1041: 50, 1000: 50}, 2048)
    taken = collections.Counter()
    for length, low, high, _, _, _ in rows:
        assert low == taken[length]
        taken[length] = high
    assert taken == {7: 1000, 3: 10, 2048: 5, 1041: 50, 1000: 50}


def test_sharding(spark, messy, none):
    got = sharding.digest(sharding.shard_documents(messy)).collect()
    text = lambda r: (r.text or "").encode()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r.doc_id, len(text(r)) + 16, zlib.crc32(text(r))) for r in messy.collect())
    shards = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 40
        shards[r.shard].append(r.slot)
    sizes = [len(shards[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert sharding.shard_documents(none).count() == 0


def walk(counts, shards, vnodes, cells):
    """The ring key by key: a key goes to its own shard while that has room, the others go clockwise afterwards."""
    at, owner = sharding.ring(shards, vnodes, cells)
    nodes = sorted(zip(at.tolist(), owner.tolist(), strict=True))
    total = sum(counts.values())
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    where, waiting = {}, []
    for cell in sorted(counts):
        first = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        for rank in range(counts[cell]):
            s = nodes[first][1]
            if room[s]:
                room[s] -= 1
                where[cell, rank] = s
            else:
                waiting.append((cell, rank, first))
    for cell, rank, first in waiting:
        turn = [nodes[(first + k) % len(nodes)][1] for k in range(1, len(nodes) + 1)]
        s = next((s for s in turn if room[s]), None)
        s = max(room, key=lambda x: (room[x], -x)) if s is None else s
        room[s] -= 1
        where[cell, rank] = s
    return where


def test_layout_equals_a_walk_of_the_ring():
    rng = np.random.default_rng(5)
    for shards, vnodes, cells, n in ((3, 2, 8, 50), (5, 4, 64, 700), (7, 3, 128, 10), (4, 8, 64, 1), (40, 4, 512, 3000)):
        cell, count_ = np.unique(rng.integers(0, cells, n) ** 2 % cells, return_counts=True)
        counts = dict(zip(cell.tolist(), count_.tolist(), strict=True))
        counts[int(cell[0])] += n // 2  # a hot cell
        got = {(c, i): s for c, low, high, s, _ in sharding.layout(counts, shards, vnodes, cells) for i in range(low, high)}
        assert got == walk(counts, shards, vnodes, cells)


def test_sharding_of_rows_without_an_id(spark):
    """A third of the rows share the null id; slots stay gapless and counts even, and every row keeps to its cell's shards."""
    rows = [(None if i % 3 == 0 else i, f"text {i % 50} of {i}") for i in range(900)] + [(None, "same"), (None, "same")]
    got = sharding.digest(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_ring_moves_few_keys():
    counts = dict(zip(*(x.tolist() for x in np.unique(np.random.default_rng(0).integers(0, sharding.CELLS, 50_000), return_counts=True)), strict=True))
    where = lambda n: {(c, i): s for c, low, high, s, _ in sharding.layout(counts, n) for i in range(low, high)}
    a, b = where(40), where(41)
    assert len(a) == len(b) == 50_000
    assert sum(a[k] != b[k] for k in a) < 0.12 * len(a)


def test_substring_dedup(spark, messy, none):
    rows = [(r.doc_id, words(r.text)) for r in messy.collect()]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    expected = []
    for doc_id, w in rows:
        gone = covered(w, lambda k: seen[k] > 1, 35)
        expected.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    for start in (9, 18, 5, 35):
        got = substring_dedup.substring_dedup(messy, start=start)
        assert count(substring_dedup.digest(got).collect()) == count(expected)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_least_windows_of_runs():
    r = np.random.default_rng(4)
    w = words_of([" ".join(map(str, r.integers(0, 60, n))) for n in (200, 3, 0, 35, 36, 34, 500)])
    runs, least, spots, base = substring_dedup._least(w, 9, 35)
    assert runs.tolist() == [i for a, b in zip(w.first[:-1], w.first[1:], strict=True) for i in range(a, b - 34)]
    assert least.tolist() == [base[i : i + 27].min() for i in runs]
    assert spots.tolist() == sorted({i + k for i in runs for k in range(27) if base[i + k] == base[i : i + 27].min()})


def test_substring_levels():
    assert substring_dedup.lengths(5, 35) == [5, 10, 20, 35]
    assert substring_dedup.lengths(substring_dedup.START, substring_dedup.TARGET) == [9, 18, 35]
    assert substring_dedup.lengths(35, 35) == [35]


def test_keep_bitmaps_name_the_lines_that_stay(spark):
    line = "a line that is shared by many documents, " * 2
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(100)] + [line] * 30 + ["end"])) for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5].keep_bits is None and got[5].n_dropped == 0
    for i in range(5):
        assert set(got[i].keep_bits) == {1, 2}  # lines 100 to 129; the first word keeps all
        kept = [k for k in range(131) if k // 63 not in got[i].keep_bits or got[i].keep_bits[k // 63] >> (k % 63) & 1]
        assert kept == [*range(100), 130]


def test_line_dedup(spark, messy, none):
    upper = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(line_dedup.SPACE).translate(upper)
    rows = [(r.doc_id, r.text or "") for r in messy.collect()]
    holders = collections.defaultdict(set)
    for row in rows:
        for line in row[1].split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(row)
    expected = []
    for doc_id, text in rows:
        lines = text.split("\n")
        drop = lambda line: len(holders.get(key(line), ())) >= 5 and doc_id != max((i for i, _ in holders[key(line)] if i is not None), default=None)  # noqa: B023, E731
        kept = [x for x in lines if not drop(x)]
        expected.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert count(line_dedup.digest(line_dedup.line_dedup(messy)).collect()) == count(expected)
    assert any(r[2] for r in expected)
    assert line_dedup.line_dedup(none).count() == 0


def test_no_python_in_native_operators(spark, messy):
    for df in (quality_rules.digest(quality_rules.quality_rules(messy)), line_dedup.digest(line_dedup.line_dedup(messy))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
