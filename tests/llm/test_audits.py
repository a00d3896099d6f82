"""Conversation repair, the filter audit and licence scans against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import conversation_repair as cr
from brindle.llm import filter_audit as fa
from brindle.llm import license_scan as ls

# --- conversations ------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, conv string, part int, seg long, row long, name string, at int"
SPACES = " \t\n\v\f\r"
TAILS = ("", "u", "a", "ua", "au", "uu", "aa")
VALID = re.compile(r"(s?(ua)+)?\Z")
LONG = {"u": "user", "a": "assistant"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3, "n", 4) for r in rows], TURNS)


def text_of(rnd):
    return rnd.choice(["", " \n", "Yes.", "No!", "why?", "open end", "Ünïcode.", "漢字", "Yes.", "more. "])


def conversations(seed, n=60, longest=2):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "system"]) if rnd.random() < 0.8 else rnd.choice(["User", "tool", "", None, "unknown"])
            out.append((c, t if rnd.random() < 0.95 else rnd.choice([None, t + 3]), role, text_of(rnd)))
    return out


def in_order(rows):
    """Turns of each conversation; a null turn comes first."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(g, key=key) for c, g in groups.items()}


def faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def options(turn, fault):
    """Cost, edit and line of each way to treat a turn."""
    _, role, text = turn
    out = [(4, "D", None)]
    if fault not in ("blank", "duplicate"):
        extra = 3 * (fault == "truncated")
        out += [(extra, "K", (role, text)), (3 + extra, "R", ("user", text)), (3 + extra, "R", ("assistant", text))]
    return out


def exhaustive(turns):
    """Every sequence of edits, with up to two insertions anywhere."""
    marks, best = faults(turns), None
    for chosen in product(*[options(t, f) for t, f in zip(turns, marks, strict=True)]):
        for runs in product(TAILS, repeat=len(turns) + 1):
            lines, audit = [], ""
            for i, run in enumerate(runs):
                lines += [(LONG[x], "") for x in run]
                audit += "I" * len(run)
                if i < len(chosen):
                    audit += chosen[i][1]
                    lines += [chosen[i][2]] if chosen[i][2] else []
            if all(r for r, _ in lines) and VALID.match("".join(r[0] for r, _ in lines)):
                found = (sum(x[0] for x in chosen) + 3 * sum(map(len, runs)), audit, lines)
                best = min(best or found, found, key=lambda x: x[:2])
    return best


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def by_strings(turns):
    """The cheapest and least audit of each state, as whole strings."""
    states = {0: (0, "", [])}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (cost, audit, lines) in list(out.items()):
                for x in "ua":
                    if (t := STEP.get((s, x))) is not None:
                        new = (cost + 3, audit + "I", [*lines, (LONG[x], "")])
                        out[t] = min(out.get(t, new), new, key=lambda v: v[:2])
        return out

    for turn, fault in zip(turns, faults(turns), strict=True):
        after = {}
        for s, (cost, audit, lines) in inserted(states).items():
            for more, edit, line in options(turn, fault):
                t = s if line is None else STEP.get((s, line[0][:1]))
                if t is not None:
                    new = (cost + more, audit + edit, lines + ([line] if line else []))
                    after[t] = min(after.get(t, new), new, key=lambda v: v[:2])
        states = after
    return min((v for s, v in inserted(states).items() if s in (0, 3)), key=lambda v: v[:2])


def expected(turns, solve):
    marks = Counter(faults(turns))
    known = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, lines = solve(turns)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, digest


def check_repair(spark, rows, solve, **limits):
    got = {r[0]: tuple(r)[1:] for r in cr.repair_conversations(frame(spark, rows), **limits).collect()}
    assert got == {c: expected(turns, solve) for c, turns in in_order(rows).items()}


def test_repair_matches_all_sequences_of_edits(spark):
    check_repair(spark, conversations(1), exhaustive)


@pytest.mark.parametrize("limits", [{}, {"most": 3}, {"size": 8}, {"most": 1}])
def test_repair_of_long_and_parted_conversations(spark, limits):
    rows = conversations(2, 40, 12)
    hot = random.Random(3)
    rows += [(77, t, hot.choice(["user", "assistant", "system"]), text_of(hot)) for t in range(150)]  # a third of all rows
    rows += [(78, 4, "user", "same.")] * 40
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "x" * 5000 + ".")]
    check_repair(spark, rows, by_strings, **limits)


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = conversations(4, 30, 9) + [(99, t, "user", f"{t}.") for t in range(60)]
    got = defaultdict(list)
    for r in cr.repaired_turns(frame(spark, rows), most=4).orderBy("part", "seg", "at").collect():
        got[r.conv_id].append((r.role, r.text))
    for conv, turns in in_order(rows).items():
        assert got[conv] == by_strings(turns)[2]


def test_repair_edges(spark):
    assert cr.repair_conversations(frame(spark, [])).collect() == []
    assert cr.repaired_turns(frame(spark, [])).collect() == []
    gone = frame(spark, [(1, 0, "user", "a"), (2, 0, "user", "Hello.")]).withColumn("gone", F.col("conv_id") == 1)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(gone, dropped="gone").collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][5:7] == (3, "KI")


def test_damage(spark):
    rows = [(c, t, role, "One. Two! Three?") for c in range(40) for t, role in ((0, "system"), (1, "assistant"), (None, None))]
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), text
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text, fault == 0)] * (2 if fault == 3 else 1)
    assert sorted(map(str, map(tuple, cr.damage(frame(spark, rows)).collect()))) == sorted(map(str, want))


def test_ranks_are_those_of_the_strings():
    rnd = random.Random(5)
    chains = [np.array([rnd.randrange(9) for _ in range(rnd.randint(0, 40))], np.int64) for _ in range(50)]
    whole = cr.Walk(cr.MOVES, chains, np.zeros((50, 1), np.int64))
    for i, chain in enumerate(chains):
        cut = sorted(rnd.randrange(len(chain) + 1) for _ in range(3))
        parts = [chain[a:b] for a, b in zip([0, *cut], [*cut, len(chain)], strict=True)]
        macros = cr.Walk(cr.MOVES, parts, np.tile(cr.ALL, (4, 1)), trail=False).macros()
        joined = cr.Walk(macros, [np.arange(4)], np.zeros((1, 1), np.int64))
        assert (joined.cost[0] == whole.cost[i]).all() and joined.ends()[0] == whole.ends()[i]


# --- filter audit -------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, id int, part string, mask int, cls long, n int, good int"


def documents(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["ÉCOLE", "ABC", "x#y", "漢字", "Aa"]
    out = []
    for i in range(150):
        kind = rnd.random()
        n = rnd.randint(90, 130)
        w = [rnd.choice(words[:20] if kind < 0.2 else words) for _ in range(n if kind < 0.8 else rnd.randint(0, 9))]
        if kind > 0.7:
            w = [x.upper() for x in w]
        out.append((i, rnd.choice(" \n").join(w), rnd.choice(["en", "de", None, ""])))
    out += [(200 + i, out[rnd.randrange(150)][1], "en") for i in range(60)]
    out += [(300 + i, out[7][1], "fr") for i in range(80)]  # a third of the rows are one text
    out += [(5, out[5][1], "en"), (5, out[6][1], "en"), (None, out[9][1], "en"), (400, None, "en"), (401, "", "de"), (402, " \n", None)]
    return out + [(500, "long " * 20_000, "en"), (501, "long " * 20_000, "en"), (502, "long " * 19_999 + "last ", "en")]


def audit_by_hand(docs, labels):
    texts = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].append(i)
    marks = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        marks[i] = [max(marks[i][0], int(q == 1)), max(marks[i][1], int(t == 1))]
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(texts[t]) < i}
        rows.append((lang or "", {f for f, x in fails.items() if x}, *(marks[i] if i is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left, before = [r for r in left if f in r[1]], [r for r in left if f not in r[1]], left
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                total[f] += len(gone)
                assert len(before) == len(left) + len(gone)
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return out


def check_audit(spark, docs, labels, **how):
    rows = spark.createDataFrame([(*d, 1, "p", 2, 3, 4, 5) for d in docs], DOCS)
    got = fa.filter_audit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **how).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == audit_by_hand(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_audit_matches_every_order_by_hand(spark):
    docs = documents(1)
    labels = [(i, i % 3 % 2, i % 5 // 4) for i in range(0, 320, 2)] + [(4, None, 1), (None, 1, 1)]
    check_audit(spark, docs, labels, block=8)


def test_audit_tells_different_texts_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(fa, "block_hashes", lambda text, block=0: F.array(F.lit(7).cast("long")))  # names only tell lengths
    check_audit(spark, documents(2), [(1, 1, 0)])


def test_audit_of_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fa.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_masks_of_a_text_of_over_21_million_letters(spark):
    texts = spark.range(2).select(F.expr("repeat(if(id = 0, 'A', 'a'), 22000000)").alias("text")).withColumn("words", fa.words_of(F.col("text")))
    assert sorted(r.own for r in texts.select(fa.masks(F.col("text"), F.col("words")).alias("own")).collect()) == [1, 5]  # few words; capitals too


def test_blocks_of_a_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(100)) + "é"
    row = spark.createDataFrame([(text,), ("",), ("abcd",)], "t string").select(F.size(fa.block_hashes(F.col("t"), 4)).alias("n"), F.get(fa.block_hashes(F.col("t"), 4), F.lit(0)).alias("h"), F.xxhash64(F.substring("t", 1, 4)).alias("w")).collect()
    assert [r.n for r in row] == [4, 0, 1]  # 4, 16, 64, then the rest
    assert row[0].h == row[0].w and row[0].h == row[2].h


def test_blocks_are_cut_at_bytes(spark):
    row = spark.createDataFrame([("é" * 60,)], "t string").select(fa.block_hashes(F.col("t"), 3).alias("h"), F.xxhash64(F.substring(F.col("t").cast("binary"), 1, 3)).alias("w")).first()
    assert len(row.h) == 4 and row.h[0] == row.w  # 120 bytes: 3 (half a letter at the end), 12, 48, the rest


def test_audit_of_texts_that_differ_inside_a_letter(spark):
    texts = ["é" * 60, "é" * 59 + "è", "è" + "é" * 59, "漢" * 40, "漢" * 39 + "漣", "É" * 60, "A" * 120, "A" * 11 + "É" * 99, "A" * 12 + "É" * 88]
    check_audit(spark, [(10 * n + i, t, "en") for n in range(2) for i, t in enumerate(texts)], [(11, 1, 1)], block=3)


# --- licences -----------------------------------------------------------------

SCANNED = "doc_id long, text string, key int, word int, at int, n_words int, places string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def notice(label):
    return max((t for t in ls.TEMPLATES if t[0] == label), key=lambda t: len(t[1]))[1]


def license_texts(seed):
    rnd = random.Random(seed)
    plain = ["the", "of", "under", "license", "work", "mit", "cc", "by", "Größe", "gnu", "x1"]
    out = [(i, rnd.choice([" ", "\n", "-", ", "]).join(rnd.choice(plain) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    for i in range(30):
        words = notice("mit").split()
        if i % 2:
            words[rnd.randrange(10, 25)] = "zzz"
        out.append((200 + i, f"int main {i}; " + " ".join(words) + " end"))
    out += [(300, notice("apache-2.0").upper()), (301, notice("bsd-2-clause") + " " + notice("bsd-3-clause")), (302, "Licensed under CC BY-NC 4.0."), (303, "MIT license mit-LICENSE MIT.license")]
    out += [(304, " ".join(notice("gpl-3.0").split()[:12])), (305, notice("gpl-3.0")), (306, notice("gpl-2.0"))]
    return out + [(None, "Apache License"), (7, None), (8, ""), (9, "mit license " * 30_000), (9, "mit license"), (9, "mit license")]


def base_by_hand(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words, at, labels = WORD.findall(lower), [], set()
    for phrase, label in ls.PHRASES:
        phrase = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licence_scan(spark):
    texts = license_texts(1)
    rows = spark.createDataFrame([(*t, 1, 2, 3, 4, "p") for t in texts], SCANNED)
    got = ls.license_labels(ls.scan_licenses(rows)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((i, *base_by_hand(t))) for i, t in texts)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[200 + i].labels == "mit" and by_id[200 + i].score > (0.98 if i % 2 else 0.999) for i in range(30))
    assert by_id[300].labels == "apache,apache-2.0" and by_id[301].labels == "bsd-2-clause,bsd-3-clause"
    assert by_id[302].labels == "cc-by,cc-by-nc-4.0" and by_id[303].base_labels == "mit" and by_id[303].n_base == 3
    assert by_id[304].labels == "" and by_id[304].score == 0  # half a notice without its key phrases
    assert by_id[305].labels == "gpl,gpl-3.0" and by_id[306].labels == "gpl,gpl-2.0"
    assert by_id[8].score == 0 and by_id[None].score == ls.NAMED


def test_licence_scan_of_no_rows(spark):
    assert ls.scan_licenses(spark.createDataFrame([], SCANNED)).collect() == []


def test_alignments_against_all_pairs():
    rnd = random.Random(2)
    known = ls.licences()
    n = len(known.vocabulary)
    frequency = {w: rnd.randint(1, 50) for w in range(n) if rnd.random() < 0.9}
    index = ls.postings(known, frequency, 60)
    rank = {w: int(index.order[w]) for w in range(n)}
    word, at, doc = [], [], []
    for d in range(40):
        place = 0
        for _ in range(rnd.randint(0, 3)):
            text = known.texts[rnd.randrange(len(known.texts))]
            a = rnd.randrange(len(text))
            for w in text[a : a + rnd.randint(1, 30)].tolist() if rnd.random() < 0.7 else rnd.choices(range(n), k=10):
                place += rnd.choice([1, 1, 1, 1, 2])
                word, at, doc = [*word, w], [*at, place], [*doc, d]
    got = set(zip(*(x.tolist() for x in ls.alignments(index, np.array(word), np.array(at), np.array(doc))), strict=True))
    want = set()
    for d in range(40):
        said = [(w, p) for w, p, x in zip(word, at, doc, strict=True) if x == d]
        for t, text in enumerate(known.texts):
            rare = sorted({w for w in text.tolist() if w in frequency}, key=rank.get)[: ls.POSTED]
            looked = sorted({w for w, _ in said if w in rare}, key=rank.get)[: ls.LOOKED_UP]
            agree = defaultdict(set)
            for w, p in said:
                for q in np.flatnonzero(text == w).tolist() if w in looked else ():
                    agree[p - q].add(w)
            want |= {(d, t, o) for o, words in agree.items() if len(words) >= ls.AGREE}
    assert got == want
