"""Exact duplicates, tokenizer alignment and conversation repair: against brute force and on odd rows."""

import collections
import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import align, exact, repair

SF = "/root/testdata/sf0.001"


# Exact duplicates

def brute_groups(rows):
    own = collections.defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        own["".join(c for c in text or "" if c not in " \t\n\v\f\r")].append((-len(text or ""), doc_id is None, doc_id, k))
    out = []
    for text, members in own.items():
        best = min(members)
        out += [(m[2], best[2], len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


ROWS = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab "), (6, "a  b"), (7, "ab"), (7, "ab"), (None, "abc"), (None, "abc"), (8, "a b c"), (9, "x" * 300_000), (10, "x" * 150_000 + "\n" + "x" * 150_000), (11, " ab"), (12, "é")]


def own_rows(frame):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in frame.collect()), key=str)


def test_exact_duplicates(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"row": F.lit("clash"), "key": F.lit(0), "at": F.lit(1)})
    got = exact.exact_duplicates(frame, keep=("row", "key"))
    assert own_rows(got) == brute_groups(ROWS)
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()
    assert got.columns == ["doc_id", "row", "key", "keep_id", "group_size", "kept", "text_sha256"] and got.where("row <> 'clash'").isEmpty()
    assert exact.exact_duplicates(frame.limit(0)).count() == 0


def test_exact_duplicates_with_colliding_keys_full_buckets_and_pages(spark, monkeypatch):
    """Keys of 3 values, so that chains hold many texts; buckets of 1 key and pages of 2 entries."""
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(5)))) for k in range(600)]

    class Weak:
        def __init__(self, data):
            self.data = data

        def digest(self):
            first = len(self.data) % 3 << 61
            return first.to_bytes(8, "big") + hashlib.md5(self.data).digest() + bytes(8)

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    collapsed = exact._collapsed

    def weak(docs, keep):
        out = collapsed(docs, keep)
        return out.withColumn("key", F.shiftleft(F.pmod("key", F.lit(3)), 61))  # any key will do that equal texts share

    monkeypatch.setattr(exact, "_collapsed", weak)
    monkeypatch.setattr(exact, "ROWS", 20)
    got = exact.exact_duplicates(frame, capacity=1, page=2)
    assert own_rows(got) == brute_groups(rows)


def test_directory_doubles_and_splits_only_full_buckets():
    counts = np.zeros(16, np.int64)
    counts[:2], counts[8] = 5, 3
    depth, bucket, own = exact.grow(counts, 6)
    assert depth == 4 and own.tolist() == [4, 4, 3, 3, 2, 2, 2, 2] + [1] * 8
    assert bucket.tolist() == [0, 1, 2, 2, 4, 4, 4, 4] + [8] * 8
    assert exact.grow(counts, 100)[0] == 0
    assert exact.grow(np.array([9, 0]), 3)[0] == 1  # a bucket that cannot be split stays full


# Alignment

@functools.cache
def aligner():
    with open(align.BYTE_BPE, encoding="utf-8") as a, open(align.PIECES, "rb") as b:
        return align.Aligner(a.read(), b.read())


def brute_align(texts):
    """Groups of each text from its whole tokens by sets of byte offsets; counts over texts."""
    x = aligner()
    groups = []
    for t in texts:
        a = x.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = x.b.encode(t) if t else []
        spell_a, spell_b = (b"".join(table[i] for i in ids) for table, ids in ((x.bytes_a, a), (x.bytes_b, b)))
        if not t or not spell_a == spell_b == b" " + t.encode():
            groups.append(None)
            continue
        at = {0}
        cuts = set(itertools.accumulate(len(x.bytes_a[i]) for i in a)) & set(itertools.accumulate(len(x.bytes_b[i]) for i in b))
        out = []
        for end in sorted(cuts):
            start = max(at)
            inside = lambda ids, table: [i for i, e in zip(ids, itertools.accumulate(len(table[i]) for i in ids)) if start < e <= end]  # noqa: B023, E731
            out.append((inside(a, x.bytes_a), inside(b, x.bytes_b)))
            at.add(end)
        groups.append(out)
    held = collections.Counter(p for g in groups for p in {(i, j) for a, b in g or () for i in a for j in b})
    top = collections.defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    rows = []
    for g in groups:
        pairs = [(i, j) for a, b in g or () for i in a for j in b]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        rows.append((sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(pairs), sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs), "" if g is None else hashlib.sha256(told.encode()).hexdigest()))
    return rows


TEXTS = [None, "", " ", "word", "two words", "two  words", " lead", "tail ", "a\nb c\n", "it's John's", "x y z  q", "a  b", "日本語 テキスト 混ぜる", "🙂 ok 👩‍👩‍👧 done", "mark ▁ inside", "</s> <s> <unk> <|endoftext|> [INST]", "<0x41> x", "ﬁne ﬀ É é", "tab\tone\t two", "zero\x00byte here", "1234567 89,01 !!!??? ---", "a​b ﻿c", "\r\nline\r\n", "q" * 5000, "ab" * 3000 + " end", "aé" * 2000, "Ünglich " * 300, "nb\u0085x \x1c y", "two words"]


def test_alignment_looks_new_parts_up_without_a_walk_through_known_ones():
    class Numbers(dict):
        def keys(self):
            raise AssertionError("all known parts were read")

        __iter__ = items = keys

    known = align._Parts(aligner())
    known.number = Numbers()
    first = ["some words, some more.", "words of a text", None, ""]
    want = [(tuple(own), digest, pairs.tolist(), n.tolist()) for own, digest, pairs, n in align.align(first, align._Parts(known.aligner))]
    for _ in range(2):
        assert [(tuple(own), digest, pairs.tolist(), n.tolist()) for own, digest, pairs, n in align.align(first, known)] == want


def test_alignment_against_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(align, "LINKS", 50)
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(8).collect()]
    texts = TEXTS + real
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("pair", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: tuple(r)[2:] for r in align.alignments(frame, keep=("block",)).collect()}
    for k, want in enumerate(brute_align(texts)):
        assert got[k] == want, (k, texts[k])
    assert got[3][0] > 0 and got[14] == (0, 0, 0, 0, 0, 0, "") and got[15][0] > 10
    assert align.alignments(frame.limit(0)).count() == 0
    nobody = align.alignments(spark.createDataFrame([(None, "x y"), (None, None), (None, "x y")], "doc_id long, text string")).collect()
    assert sorted(r["count_sum"] for r in nobody)[0] == 0 and len({tuple(r) for r in nobody}) == 2


# Conversation repair

def brute_repair(rows):
    """Cheapest edits and least audit by relaxing whole paths. rows: codes of repair.cheapest()."""
    allowed = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "")}
    for k in range(len(rows) + 1):
        for _ in range(4):
            for s, (c, p) in list(best.items()):
                best[due[s]] = min(best.get(due[s], (10**9, "")), (c + 2, p + "I"))
        if k == len(rows):
            return min(best[s] for s in (0, 3) if s in best)
        row, after = rows[k], {}
        for s, (c, p) in best.items():
            moves = [(3, "D", s)]
            if not row & repair.MUST_GO:
                t = row >> 3
                moves += [(2 + t, "R", due[s])] + [(t, "K", to) for (a, b), to in allowed.items() if a == s and b == row & 3]
            for w, letter, to in moves:
                after[to] = min(after.get(to, (10**9, "")), (c + w, p + letter))
        best = after


def every_audit(rows):
    """All edit sequences with up to two inserts at a place, for very short conversations."""
    out = []

    def go(k, state, cost, audit, inserts):
        if k == len(rows) and state in (0, 3):
            out.append((cost, audit))
        due = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if inserts < 2:
            go(k, due, cost + 2, audit + "I", inserts + 1)
        if k < len(rows):
            row = rows[k]
            go(k + 1, state, cost + 3, audit + "D", 0)
            if not row & repair.MUST_GO:
                go(k + 1, due, cost + 2 + (row >> 3), audit + "R", 0)
                if (state, row & 3) in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
                    go(k + 1, row & 3, cost + (row >> 3), audit + "K", 0)

    go(0, 0, 0, "", 0)
    return min(out)


def test_bidirectional_search_finds_the_least_audit():
    codes = [c | f for c in range(4) for f in (0, repair.MUST_GO, repair.TRUNCATED)]
    for n in (0, 1, 2):
        for rows in itertools.product(codes, repeat=n):
            assert repair.cheapest(bytes(rows)) == brute_repair(rows) == every_audit(rows)
    rnd = random.Random(11)
    for _ in range(1500):
        rows = bytes(rnd.choice(codes if rnd.random() < 0.5 else [1, 2, 3, 2, 3, 3]) for _ in range(rnd.randrange(3, 25)))
        want = brute_repair(rows)
        assert repair.cheapest(rows) == want
        for segment in (1, 3, 7):
            lattice = repair.Lattice(segment)
            for row in rows:
                lattice.add(row)
            assert lattice.best() == want


def brute_conversations(conversations):
    """The whole contract on lists of (conv_id, turn, role, text)."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in conversations:
        by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        by[conv] += [] if kind == 0 else [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [t for known, t, _, _ in rows if known]
        faults, codes, seen = [0, 0, 0], [], set()
        for _, _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | {None: 0, 2: 8}.get(fault, 4))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = brute_repair(codes)
        lines, state, left = [], 0, iter(rows)
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            state = {"s": 1, "u": 2, "a": 3}[row[2][0]] if letter == "K" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
            lines.append(f"{row[2] if letter == 'K' else {2: 'user', 3: 'assistant'}[state]}:{row[3] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversation_repair(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool", "unknown"]), rnd.choice(["Yes.", "no", "", None, "  \n", "What? ", "A. b", "Well!\n"])) for c in range(150) for t in range(rnd.randrange(1, 12)) if rnd.random() < 0.8]
    rows += [(None, 0, "user", "hi."), (None, None, None, None), (-5, None, "user", "a."), (-5, None, "assistant", "b."), (-5, 7, "system", "c"), (900, 3, "user", "x" * 200_000 + "."), (900, 4, "assistant", "é" * 100_000)]
    rows += [(901, t, "user" if t % 2 else "assistant", f"Turn {t}{'.' if t % 7 else ''}") for t in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit("clash"), "gone": F.lit("clash"), "audit": F.lit("clash"), "copy": F.lit("clash")}).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damage(frame)).collect()}
    want = brute_conversations(rows)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert got[conv] == row, conv
    assert repair.repair(repair.damage(frame.limit(0))).count() == 0


def test_repaired_rows_make_legal_conversations(spark):
    rows = repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    out = repair.repaired(rows, repair.audits(rows, segment=3))
    told = out.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: F.substring(x.role, 1, 1)), "").alias("roles"))
    assert told.where("not roles rlike '^(s?(ua)+)?$'").isEmpty() and told.count() > 10


@pytest.mark.parametrize("segment", [2, 1000])
def test_segments_change_nothing(spark, segment):
    rows = repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert sorted(map(tuple, repair.audits(rows, segment).collect())) == sorted(map(tuple, repair.audits(rows).collect()))
