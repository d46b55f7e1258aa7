import hashlib
import random
import re
import zlib

from lodestone.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, at long, block long"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def brute_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute_best(rows):
    """(cost, audit, turns) by plain search over (rows used, role initials so far as the grammar sees them), whole strings compared."""
    allowed = re.compile(r"(s?(ua)+)?")
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # roles' initials, shortened to what matters: whether anything, s alone, or the last of u and a
    short = lambda r: r if r in ("", "s") else r[-1]

    def grown(states):
        for _ in range(3):
            for key, (cost, audit, turns) in list(states.items()):
                role = "assistant" if key == "u" else "user"
                offer(states, role[0], (cost + 2, audit + "I", (*turns, f"{role}:")))

    def offer(states, key, found):
        if key not in states or found[:2] < states[key][:2]:
            states[key] = found

    # a state keeps every cheapest string, and strings that only end in insertions are told apart by their own steps
    for (_, role, text), fault in zip(rows, faults, strict=True):
        grown_ = dict(best)
        grown(grown_)
        after = {}
        for key, (cost, audit, turns) in grown_.items():
            offer(after, key, (cost + 3, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                to = "assistant" if key == "u" else "user"
                offer(after, to[0], (cost + 2 + more, audit + "R", (*turns, f"{to}:{text}")))
                i = role[:1]
                if i and allowed.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[key] + i) or i == "s" and key == "" or i == "u" and key != "u":
                    offer(after, short(i), (cost + more, audit + "K", (*turns, f"{role}:{text}")))
        best = after
    grown(best)
    return min((found for key, found in best.items() if key in ("", "a")), key=lambda f: f[:2]), faults


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        left = brute_damaged([r for r in rows if r[0] == conv])
        (cost, audit, turns), faults = brute_best(left)
        known = [t for t, _, _ in left if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120, most=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "uncle", "", None]
    texts = ["One.", "Two!", "no end", "x?", " ", "", None, "é ü. \n", "a ", "b  ", "tail. \t", "long " * 300]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, most)):
            rows.append((conv, rng.choice([None, *range(12)]) if rng.random() < 0.3 else rng.randrange(40), rng.choice(roles), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def taken(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_equals_brute_force_in_one_pass_and_in_blocks(spark):
    rows = made(1)
    want = brute(rows)
    assert taken(c.query(frame(spark, rows))) == want
    assert taken(c.query(frame(spark, rows), most_rows=3, block=4)) == want


def test_one_conversation_of_many_rows_goes_through_blocks(spark):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No!", "so", f"n{i}."])) for i in range(3000)]
    rows += [(8, i, "user", "same.") for i in range(40)]
    assert taken(c.query(frame(spark, rows), most_rows=100, block=64)) == brute(rows)


def test_trails_compare_as_their_strings():
    rng = random.Random(3)
    trail = c.Trail()
    nodes, texts = [0], [""]
    for _ in range(2000):
        at = rng.randrange(len(nodes))
        letter = rng.choice("DIKR")
        nodes.append(trail.push(nodes[at], letter))
        texts.append(texts[at] + letter)
    long = 0
    for letter in rng.choices("DK", k=3000):
        long = trail.push(long, letter)
    for _ in range(4000):
        i, j = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert trail.before(nodes[i], nodes[j]) == (texts[i] < texts[j])
    assert "".join(trail.letters(nodes[-1])) == texts[-1] and len(trail.up[long]) == 12


def test_equal_hashes_are_verified(monkeypatch):
    trail = c.Trail()
    one = two = 0
    for a, b in zip("KDIR", "KRID", strict=True):
        one, two = trail.push(one, a), trail.push(two, b)
    trail.hash = [0] * len(trail.hash)
    assert trail.before(one, two) and not trail.before(two, one) and not trail.same(one, two)


def test_odd_tables(spark):
    assert c.query(frame(spark, [])).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert taken(c.query(frame(spark, [(gone, 1, "user", "Hi.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_its_sql(spark):
    from lodestone.llm.queries import ORACLES, op12_conversations
    from tests.compare import connect, differences

    sf = "/root/testdata/sf0.01"
    assert differences(op12_conversations(spark, sf), connect(sf), ORACLES["op12_conversations"]) is None
