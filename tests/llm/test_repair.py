"""op11: edit strings against all edits, packed rows, edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from tracewell.llm import audit_paths, queries, repair

CODES = [r + 4 * f for r in range(4) for f in range(4)]


def brute(codes):
    """Every edit sequence with up to two inserts per gap, by its definition."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?\Z")
    options = []
    for code in codes:
        role, fault = " sua"[code & 3], code >> 2
        extra = fault == repair.TRUNCATED
        some = [("D", "", 3)]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            some += [("K", role, int(extra)), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        options.append(some)
    gaps = [("", "", 0), ("I", "u", 2), ("I", "a", 2), ("II", "ua", 4), ("II", "au", 4)]
    for inserts in itertools.product(gaps, repeat=len(codes) + 1):
        for edits in itertools.product(*options):
            audit = roles = ""
            cost = 0
            for gap, edit in itertools.zip_longest(inserts, edits, fillvalue=("", "", 0)):
                audit, roles, cost = audit + gap[0] + edit[0], roles + gap[1] + edit[1], cost + gap[2] + edit[2]
            if grammar.match(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_short_conversations(n):
    for codes in itertools.product(CODES, repeat=n):
        walk = repair.Audit()
        for c in codes:
            walk.row(c)
        assert walk.result() == brute(codes), codes


def strings(codes, modulus=None, limit=None):
    """The same program on plain strings, for longer rows; and the one under test, with colliding hashes if asked."""
    none, plain = (1 << 60, ""), [(0, ""), (1 << 60, ""), (1 << 60, ""), (1 << 60, "")]

    def closed(p):
        user = min([p[2]] + [(p[s][0] + 2, p[s][1] + "I") for s in (0, 1, 3)])
        return [p[0], p[1], user, min(p[3], (user[0] + 2, user[1] + "I"))]

    walk = repair.Audit()
    if modulus:
        walk.paths.modulus = modulus
    if limit:
        walk.paths.limit = limit
    for code in codes:
        role, fault, p = code & 3, code >> 2, closed(plain)
        extra = fault == repair.TRUNCATED
        new = [[(c + 3, t + "D")] for c, t in p]
        if fault not in (1, 2):
            for s, (c, t) in enumerate(p):
                new[repair.NEXT[s]].append((c + 2 + extra, t + "R"))
                if s in repair.KEPT[role]:
                    new[repair.KEPT[role][s]].append((c + extra, t + "K"))
        plain = [min(x) if x else none for x in new]
        walk.row(code)
    p = closed(plain)
    return walk.result(), min(p[0], p[3])


@pytest.mark.parametrize("modulus, limit", [(None, None), (7, None), (1, 16), (None, 16)])
def test_long_rows_collisions_and_settling(modulus, limit):
    rng = random.Random(3)
    for n in (3, 10, 60, 700):
        for kinds in (CODES, [0, 1, 2], [2, 3, 14, 15], [2]):
            got, want = strings([rng.choice(kinds) for _ in range(n)], modulus, limit)
            assert got == want


def test_common_prefixes():
    paths = audit_paths.Paths()
    a = b = audit_paths.ROOT
    for c in "KKRKD" * 20:
        a, b = paths.add(a, c), paths.add(b, c)
    assert paths.common(a, b) == 100 and paths.text(a) == "KKRKD" * 20
    x, y = paths.add(a, "D"), paths.add(b, "K")
    assert paths.common(x, y) == 100 and paths.less(x, "", y, "") and not paths.less(y, "", x, "")
    assert paths.less(a, "", b, "D") and not paths.less(a, "D", b, "D")
    assert paths.ancestor(a, 37) != a and paths.depth[paths.ancestor(a, 37)] == 37


def by_hand(rows):
    """The contract for the rows of one conversation after damage, in order."""
    seen, codes, counts = set(), [], [0] * 4
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * fault)
    (_, _), (cost, audit) = strings(codes)
    said, state, at = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = repair.NEXT[state]
            said.append(repair.NAMES[state] + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if edit != "D":
            state = repair.KEPT[codes[at - 1] & 3][state] if edit == "K" else repair.NEXT[state]
            said.append((role if edit == "K" else repair.NAMES[state]) + ":" + text)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def test_query_by_hand(spark):
    table = pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pandas()
    want = {}
    for conv, group in table.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        rows = []
        for turn, role, text in zip(group.turn, group.role, group.text, strict=True):
            code = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            if code:
                text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
                rows += [(turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
        want[conv] = by_hand(rows)
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_repaired_conversations"](spark, "/root/testdata/sf0.001").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == want


def test_edges(spark):
    long = "word " * 300_000 + "end."
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be kind."), (1, None, None, None), (1, 3, "", "x"),
        (None, 0, "user", long), (None, 0, "user", long), (None, 0, "assistant", "Ok!"), (2, 5, "user", " \n"), (3, 2**60, "User", "A."), (3, -5, "usher", "B?")]
    turns = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit int, conv string, kind int")
    groups = {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or " ", hashlib.sha256((r[3] or " ").encode()).hexdigest()))
    for conv, turn, role, text in order:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: r for r in repair.repair(turns.repartition(3)).collect()}
    assert set(got) == {None, 1, 2, 3}
    for conv, held in groups.items():
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == by_hand(held)
    assert got[2].audit == "D" and got[2].repaired == 0 and got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].duplicate == 1 and got[3].gaps == 2**60 + 5 + 1 - 2
    assert repair.repair(turns.where("false")).count() == 0


def test_a_long_conversation_lies_in_many_chunks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{i}.", f"{i}"])) for i in range(900)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    monkeypatch.setattr(repair, "RANGE_ROWS", 100)
    order = sorted(rows, key=lambda r: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    r = repair.repair(turns).head()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == by_hand([x[1:] for x in order])
