"""Scans, decontamination, archives, mixing and scoring against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import contamination, mixing, pii, secret_scan, suffix_tree, warc
from corpusloom.llm.common import stash

DOCS = "doc_id long, text string, lang string, source string, base string, spans string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", "x", "y") for i, t in texts], DOCS)


def luhn(s):
    return sum((d := int(c) * (1 + k % 2)) - 9 * (d > 9) for k, c in enumerate(reversed(s))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]


def reference_spans(text, kinds):
    found = [(m.start(), k, n, m.end()) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def hostile(seed):
    """Random texts over the characters that the patterns care about."""
    rng = random.Random(seed)
    parts = ["password", "token", "secret", "API_KEY", "apikey", "AKIA", "=", ":", " ", "  ", '"', "'", "abc123", "deadbeef", "0123456789abcdef", "@", "a.b", ".", "-", "+1", "(555)",
             "4111 1111 1111 1111", "4539578763621486", "1.2.3.4", "256", "999.1.1.1", "00001.2.3.4", "_", "é", "😀", "\n", "x" * 20, "Z9" * 9, "user@mail.example.com", "c_d@e.f"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(250)]


@pytest.mark.parametrize(("module", "kinds"), [("secrets", SECRETS), ("pii", PERSONAL)])
def test_base_spans_match_python(spark, module, kinds):
    texts = [None, "", "a@b.c_d@e.f", "password: token: abcdefghijklmnop", "1" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "1-" * 3000 + "1", "AKIA" * 9, *hostile(7)]
    df = docs_of(spark, list(enumerate(texts)))
    found = secret_scan.find_secrets(df) if module == "secrets" else pii.find_pii(df)
    rows = {r.doc_id: r for r in secret_scan.digest(found, tuple(k for k, _, _ in kinds)).collect()}
    for k, t in enumerate(texts):
        want = reference_spans(t, kinds)
        assert rows[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(rows[k].spans.split(","))
        assert sum(rows[k][f"n_{n}"] for n, _, _ in kinds) == len([w for w in want.split(",") if w])


def test_markov_models_add_random_strings(spark):
    rng = random.Random(2)
    alphabet = secret_scan.ALPHABET[:62]
    strings = ["".join(rng.choices(alphabet, k=24)) for _ in range(300)]
    words = ["customer_account_identifier", "configurationParameterName", "responseHandlerFactory", "international", "temperature_measurement"]
    samples = spark.createDataFrame([(s, 1) for s in strings[:250]] + [(w, 0) for w in words * 40], "value string, label int")
    df = docs_of(spark, [(1, f"see {strings[299]} here"), (2, "the customer_account_identifier of"), (3, None)])
    found = {r.doc_id: [(s.kind, s.text) for s in r.spans] for r in secret_scan.find_secrets(df, samples=samples).collect()}
    assert found == {1: [("markov", strings[299])], 2: [], 3: []}


def planted_secrets(seed, n):
    """Texts of prose and identifiers, the random strings planted without a keyword, and how they read."""
    rng = random.Random(seed)
    parts = ["user", "account", "handler", "config", "get", "value", "response", "stream", "index", "buffer", "client", "manager", "event", "status", "token", "import", "export"]
    plain = lambda: rng.choice(["_".join, "".join, "-".join])(rng.choices(parts, k=rng.randrange(2, 5))) + rng.choice(["", "2", "64", "_v3", "V2"])
    camel = lambda: "".join(w.title() for w in rng.choices(parts, k=rng.randrange(2, 5)))
    forms = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"]
    texts = []
    for k in range(n):
        words = [rng.choice([plain, camel])() for _ in range(12)] + ["2024-05-17T10:20", "call 5551234567", "page 120045", "12,500.00"]
        secret = "".join(rng.choices(forms[k % 4], k=rng.randrange(12, 16 if k % 4 == 3 else 33))) if k % 2 == 0 else None
        words.insert(rng.randrange(len(words)), secret or "the")
        texts.append((k, " ".join(words), secret))
    return texts


def test_markov_models_find_planted_secrets(spark):
    texts = planted_secrets(5, 1200)
    df = docs_of(spark, [t[:2] for t in texts])
    found = {r.doc_id: [s.text for s in r.spans if s.kind == "markov"] for r in secret_scan.find_secrets(df).collect()}
    clear = [(k, s) for k, _, s in texts if s and not re.fullmatch("[0-9a-f]{16,}", s)]
    caught = sum(s in found[k] for k, s in clear)
    wrong = sum(len([x for x in found[k] if x != s]) for k, _, s in texts)
    assert caught >= 0.9 * len(clear) and wrong <= 0.02 * 1200 * 12


def test_added_secrets_match_python(spark):
    rng = random.Random(3)
    samples = [("".join(rng.choices(secret_scan.ALPHABET[:62], k=20)), 1) for _ in range(200)] + [(w, 0) for w in ["customerAccount", "response_handler", "Error404page", "x86_64-linux-gnu"] * 40]
    table = secret_scan.train(spark.createDataFrame(samples, "value string, label int"))
    n = len(secret_scan.ALPHABET) + 1

    def ratio(value):
        at, total = 0, 0.0
        for c in value:
            to = secret_scan.ALPHABET.find(c) + 1
            total += round(table[at * n + to], 3)
            at = to
        return total

    texts = [(0, None), (1, ""), *((k + 2, t) for k, t in enumerate(hostile(11))), *((k + 1000, t) for k, t, _ in planted_secrets(8, 100))]
    texts.append((2000, " ".join("".join(rng.choices(secret_scan.ALPHABET[:62], k=16)) for _ in range(3000))))
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, texts), samples=spark.createDataFrame(samples, "value string, label int")).collect()}
    for k, t in texts:
        base = [(m.start(), m.end()) for _, p, ok in SECRETS for m in re.finditer(p, t or "") if ok(m)]
        want = set()
        for m in re.finditer(r"(?=[A-Za-z+/_=-][a-z+/_=-]*[A-Z0-9]|[0-9])[A-Za-z0-9+/_=-]{12,}", t or ""):
            if all(m.end() <= a or b <= m.start() for a, b in base) and ratio(m[0]) >= 12:
                want.add((m.start(), m.end()))
        assert {(s.start, s.end) for s in got[k].spans if s.kind == "markov"} == want, t
    assert len([s for s in got[2000].spans if s.kind == "markov"]) > 1000


def test_pii_checks_and_redaction(spark):
    texts = [(1, "my IBAN is DE89370400440532013000 now"), (2, "DE89370400440532013001 is not"), (3, "call (555) 123-4567 now"), (4, "size (555) 123-4567"), (5, None), (6, "mail a.b@c.org, é +1 (743) 555-3824!")]
    found = {r.doc_id: [(s.kind, s.text) for s in r.spans] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    assert found[1] == [("iban", "DE89370400440532013000")] and not found[2] and not found[4]
    assert found[3] == [("phone", "(555) 123-4567")]
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert clean[6] == "mail [EMAIL], é [PHONE]!" and clean[5] is None and clean[4] == texts[3][1]


def reference_added(text):
    """Further personal data by plain Python: account numbers, short cards and local phone numbers."""
    near = lambda m, words: re.search(rf"(?i)\b(?:{words})\b", text[max(0, m.start() - 40) : m.start()])
    base = [(m.start(), m.end()) for _, p, ok in PERSONAL for m in re.finditer(p, text) if ok(m)]
    clear = lambda m, taken: all(m.end() <= a or b <= m.start() for a, b in taken)

    def mod97(s):
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    ibans = [m for m in re.finditer(r"(?a:\b)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?a:\b)", text) if clear(m, base) and mod97(m[0])]
    cards = [m for m in re.finditer(PERSONAL[2][1], text) if 12 <= len(digits(m[0])) <= 13 and clear(m, base) and luhn(digits(m[0])) and near(m, "card|credit|debit|visa|karte|carte|tarjeta")]
    taken = base + [(m.start(), m.end()) for m in ibans + cards]
    phones = [m for m in re.finditer(r"(?:\([0-9]{3}\)\x20?|(?a:\b)[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?a:\b)", text) if clear(m, taken) and near(m, "phone|tel|call|mobile|telefon|téléphone|teléfono")]
    return {(k, m.start(), m.end()) for k, ms in (("iban", ibans), ("card", cards), ("phone", phones)) for m in ms}


def test_added_personal_data_matches_python(spark):
    rng = random.Random(21)

    def iban(ok):
        body = "".join(rng.choices("0123456789", k=18))
        check = 98 - int(body + "131400") % 97
        return f"DE{(check if ok else check % 97 + 1):02d}" + body

    def card(ok):
        body = str(rng.randrange(10**11, 10**12))
        return next(body + str(c) for c in range(10) if luhn(body + str(c)) == ok)

    makers = [lambda: "account " + iban(True), lambda: "account " + iban(False), lambda: "card no " + card(True), lambda: "card no " + card(False), lambda: "size " + card(True),
              lambda: "call (555) 123-4567", lambda: "part 555-123-4567", lambda: "tel 555.123.4567 x", lambda: "phone +1 (555) 123-4567", lambda: "a.b@c.org", lambda: "word " * 9, lambda: iban(True) + "x"]
    texts = [(k, ", ".join(rng.choice(makers)() for _ in range(rng.randrange(1, 9)))) for k in range(300)] + [(300 + k, t) for k, t in enumerate(hostile(3))]
    got = {r.doc_id: r for r in pii.find_pii(docs_of(spark, texts)).collect()}
    for k, t in texts:
        base = {(s.kind, s.start, s.end) for s in got[k].base}
        assert {(s.kind, s.start, s.end) for s in got[k].spans} - base == reference_added(t), t
    assert sum(len(r.spans) - len(r.base) for r in got.values()) > 200
    assert pii.find_pii(docs_of(spark, [])).count() == 0 == secret_scan.find_secrets(docs_of(spark, [])).count() and pii.redact(docs_of(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@mail.example.org" for k in range(5000))
    row = secret_scan.digest(pii.find_pii(docs_of(spark, [(1, text)])), pii.KINDS).first()
    assert row.n_email == 5000 and row.base_sha256 == hashlib.sha256(reference_spans(text, PERSONAL).encode()).hexdigest()


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 60)))) for k in range(30)] + [(30, None), (None, "a b c d e f"), (0, "p q r s t u v"), (31, ""), (32, "alpha Beta gamma delta"), (33, "solo"), (34, "two Words"), (35, "!!")]
    texts = [(k, " ".join(word() for _ in range(rng.randrange(0, 400)))) for k in range(60)] + [(60, None)]
    for k in range(0, 60, 3):
        own = items[k // 2][1].split()
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = "zz"
        texts[k] = (k, texts[k][1] + " X, " + " ".join(own).upper() + "! " + texts[k][1])
    texts += [texts[0], (61, "x alpha beta gamma delta y"), (62, "alpha beta, gamma"), (63, "SOLO."), (64, "a two words b " + "w1 " * 40000), (65, "words two")]

    def words(t):
        return re.findall(r"[a-z0-9]+", (t or "").lower())

    def runs(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, q in items:
        k = min(5, len(words(q)))
        if i is not None and k:
            s = runs(words(q), k)
            want |= {(d, i) for d, t in texts if len(s & runs(words(t), k)) >= 0.8 * len(s) - 1e-9}
    assert {(61, 32), (63, 33), (64, 34)} <= want
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (32 << 20, 2000):
        got = contamination.contained_items(docs_of(spark, texts), table, block_bytes=size).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
    kept = contamination.decontaminate(docs_of(spark, texts), table)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in want}
    assert contamination.decontaminate(docs_of(spark, texts), table.limit(0)).count() == len(texts)
    assert contamination.contained_items(docs_of(spark, []), table).count() == 0


def test_archives_round_trip(spark):
    pages = [(3, "http://a", "same"), (1, "http://b c", "same"), (2, None, "other é" * 500), (4, "u", None), (5, "u", ""), (None, "u", "same"), (1, "http://b c", "same"), (9, "x", "\r\n\r\n" * 9)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha long")
    rows = warc.archive_round_trip(df, archive_bytes=2000, dictionary_sample=9000).collect()
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    body = lambda h: (h or "").encode()
    firsts = {}
    for i, _, h in pages:
        if i is not None:
            firsts[body(h)] = min(i, firsts.get(body(h), i))
    want = []
    for i, _, h in pages:
        first = firsts[body(h)]
        again = i is not None and i > first
        want.append((i or -1, "revisit" if again else "response", first if again else None, len(body(h)), warc.payload_digest(body(h))))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {body(h) for _, _, h in pages}
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    assert warc.train_dictionary([], 100) == b"" and warc.train_dictionary([b"ab", b"cd"], 3) == b"bcd"  # too few to train one
    with_odd_names = df.withColumnRenamed("sha", "refers_to").withColumn("payload", F.lit(1)).withColumn("h", F.lit(1))
    assert warc.archive_round_trip(with_odd_names).count() == len(pages)
    everything = warc.archive_round_trip(df, least_bytes=100).collect()
    assert all(r.record_type == "response" for r in everything)


def test_targets_stop_at_twice_the_size():
    targets = mixing.cycled_targets({"b": 100, "a": 10, None: 50, "c": 40})
    assert targets["a"] == 20 and sum(targets.values()) == pytest.approx(300)
    assert all(targets[s] <= 2 * n + 1e-9 for s, n in {"b": 100, "a": 10, None: 50, "c": 40}.items())


def test_flow_spreads_repetitions():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    assert sum(w for (_, q), w in flow.items() if q == "a") == 15
    per = collections.Counter()
    for (p, _), w in flow.items():
        per[p] += w
    assert all(w <= 10 for w in per.values())  # nothing repeats while there are words left
    flow = mixing.route({("a",): 10, ("b",): 10}, {"a": 18, "b": 30})
    assert flow[("a",), "a"] == 18 and flow[("b",), "b"] == 20


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 60))), f"s{rng.randrange(4)}" if k % 9 else None) for k in range(800)] + [(800, None, "s0"), (801, "", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, draw int")
    first, second = mixing.mix(df).collect(), mixing.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in second)
    taken, target = collections.Counter(), {}
    for r in first:
        assert r.size == len((rows[r.doc_id][1] or "").split()) and 0 <= r.taken <= 2 * r.size
        taken[rows[r.doc_id][2]] += r.taken
        target[rows[r.doc_id][2]] = r.target
    assert len(first) == 802
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t + 5
    assert mixing.mix(df.limit(0)).count() == 0
    many = spark.createDataFrame([(k, "a b c", [["x"], ["x", "y"], ["y"], []][k % 4]) for k in range(200)], "doc_id long, text string, source array<string>")
    got = mixing.mix(many).collect()
    assert len(got) == 200 and all(r.taken == 0 for r in got if not r.sources)


@pytest.mark.parametrize("same", ["id", "null", "row", "hot"])
def test_mix_draws_copies_one_by_one(spark, same):
    words = {"id": lambda k: f"x{k} " * 50, "null": lambda k: "x " * 50, "row": lambda k: "x " * 50, "hot": lambda k: "x " * 50}[same]
    ids = {"id": lambda k: 7, "null": lambda k: None, "row": lambda k: 7, "hot": lambda k: k if k > 700 else 7}[same]
    rows = [(ids(k), words(k), "a") for k in range(1000)] + [(5000 + k, "y " * 20, "b") for k in range(500)] + [(None, "", "a"), (None, None, None), (1, "z " * 90_000, "c"), (2, "c " * 30, "c")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, copy int, key string")
    first, again = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert len(first) == len(rows) and sorted(map(key, first)) == sorted(map(key, again))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes)
    taken = collections.Counter()
    for r in first:
        assert (r.source_size, r.target) == (sizes[r.sources[0]], pytest.approx(targets[r.sources[0]])) and r.taken <= 2 * r.size
        taken[r.sources[0]] += r.taken
    assert abs(taken["a"] - targets["a"]) <= 100 and abs(taken["b"] - targets["b"]) <= 40


def brute_targets(sizes):
    """Raise all sources together, five, two and one words at a time, until the words are spent."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        spent = sum(min(2 * sizes[s], level * weight[s]) for s in order)
        low, high = (level, high) if spent < 1.5 * sum(sizes.values()) else (low, level)
    return {s: min(2 * sizes[s], low * weight[s]) for s in order}


def reference_scores(texts):
    tokens = [((t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode()) % 5 if i is not None else None) for i, t in texts]
    c = collections.Counter()
    for words, fold in tokens:
        if fold is not None and fold != 1:
            c.update(words)
    n, v = sum(c.values()), len(c)
    return c, n, [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) for words, _ in tokens]


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_base_scores_match_python(spark, block):
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choices(["The", "cat", "sat", "on", "mat", f"r{k}"], k=rng.randrange(0, 30)))) for k in range(200)] + [(200, None), (201, ""), (None, "the cat")]
    rows = suffix_tree.scores(docs_of(spark, texts), block_bytes=block, bucket_words=50).collect()
    c, n, base = reference_scores(texts)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for (i, t), b in zip(texts, base, strict=True):
        words = (t or "").encode().lower().split() + [None]
        r = by[i]
        assert r.base_score == pytest.approx(b) and r.n_tokens == len(words) and r.n_known == sum(c[w] > 0 for w in words) and r.train_tokens == n
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
    assert suffix_tree.scores(docs_of(spark, [])).count() == 0


def reference_tree(texts, depth=3, least=2):
    """The suffix tree by dictionaries: log10 probabilities of texts (id, words)."""
    c, n, _ = reference_scores(texts)
    docs = [((t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 5 != 1) for i, t in texts]
    follow = collections.defaultdict(collections.Counter)
    asked = collections.defaultdict(set)
    for words, learned in docs:
        for t in range(len(words)):
            for k in range(1, min(depth, t) + 1):
                asked[tuple(words[t - k : t])].add(words[t])
                follow[tuple(words[t - k : t])][words[t]] += learned
    runs = collections.Counter()
    for words, learned in docs:
        for t in range(len(words)):
            for k in range(1, min(depth, t + 1) + 1):
                runs[tuple(words[t - k + 1 : t + 1])] += learned
    model = {}

    def is_open(s):
        return s in model and model[s][3]

    def predict(s, x):
        if not s:
            return (c[x] + 0.5) / (n + 0.5 * (len(c) + 1))
        p = predict(s[1:], x)
        if s in model and model[s][0]:
            kept, left, whole, _ = model[s]
            count = follow[s][x] if follow[s][x] >= least else 0
            p = (count + left * p) / whole
        return p

    for k in range(1, depth + 1):
        for s in [s for s in asked if len(s) == k and runs[s] >= least and (k == 1 or is_open(s[1:]))]:
            whole = sum(follow[s].values())
            seen = {x: m for x, m in follow[s].items() if m >= least}
            rest, events = whole - sum(seen.values()), len(seen)
            prior = {x: 2 ** (-round(-64 * math.log2(predict(s[1:], x))) / 64) for x in seen}
            gain = sum(m * math.log(m / whole / prior[x]) for x, m in seen.items())
            if rest:
                gain += rest * math.log(rest / whole / max(1 - sum(prior.values()), 1e-12))
            fixed = events == 1 and rest == 0
            model[s] = (events > 0 and gain > 0.5 * events * math.log(max(whole, 2)), 1 if fixed else max(2, rest + events), whole + events, not fixed)
    return [sum(math.log10(predict_longest(predict, model, words, t, depth)) for t in range(len(words))) for words, _ in docs], model


def predict_longest(predict, model, words, t, depth):
    """The deepest context that its suffixes lead to."""
    k = 0
    while k < min(depth, t) and tuple(words[t - k - 1 : t]) in model:
        k += 1
    return predict(tuple(words[t - k : t]), words[t])


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "bucket_words": 40}, {"block_bytes": 900, "bucket_words": 30, "hot_count": 60}, {"block_bytes": 700, "bucket_words": 400, "slice_rows": 20}, {"block_bytes": 900, "bucket_words": 200, "hot_count": 60, "slice_rows": 7}])
def test_tree_matches_dictionaries(spark, options):
    rng = random.Random(9)
    texts = [(500, None), (501, ""), (None, "a b c a b c"), (502, "a " * 3000)]
    for k in range(150):
        words, w = [], "a"
        for _ in range(rng.randrange(1, 40)):
            w = {"a": "b", "b": "c", "c": "a"}.get(w, "a") if rng.random() < 0.8 else rng.choice(["a", "b", "c", f"x{rng.randrange(60)}"])
            words.append(w)
        texts.append((k, " ".join(words)))
    texts += [(600, texts[10][1]), (600, texts[10][1]), (601, " ".join(f"u{k}" for k in range(30))), (602, " ".join(f"u{k}" for k in range(30)))]
    got = collections.defaultdict(list)
    for r in suffix_tree.scores(docs_of(spark, texts), **options).collect():
        got[r.doc_id].append(r)
    want, model = reference_tree(texts)
    kept = {k: sum(len(s) == k and m[0] for s, m in model.items()) for k in (1, 2, 3)}
    assert all(kept.values()) and sum(map(len, got.values())) == len(texts)
    for (i, _), score in zip(texts, want, strict=True):
        assert got[i][0].score == pytest.approx(score, abs=1e-6), i


def test_repeated_texts_score_apart(spark):
    rng = random.Random(10)
    texts = [(k, " ".join(f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(60))) for k in range(300)]
    texts += [(1000 + k, texts[k][1]) for k in range(40)]
    rows = {r.doc_id: r for r in suffix_tree.scores(docs_of(spark, texts)).collect()}
    twice = sorted(rows[1000 + k].score / rows[1000 + k].n_tokens for k in range(40) if not rows[k].held_out and not rows[1000 + k].held_out)
    once = sorted(rows[k].score / rows[k].n_tokens for k in range(40, 300))
    assert twice[0] > once[-10]


def test_tested_contexts_sum_to_one():
    import numpy as np

    context = np.array([5, 5, 5, 9, 9, 5], dtype=np.uint64)
    word, counts = np.array([1, 2, 3, 1, 1, 1], dtype=np.uint64), np.array([40, 8, 1, 2, 1, 5])
    prior = np.rint(-64 * np.log2(np.array([0.3, 0.2, 0.1, 0.3, 0.3, 0.3]))).astype(np.int64)
    codes, owner, c, rest, events, whole, kept = suffix_tree.tested(context, word, counts, prior, 2)
    assert codes.tolist() == [5, 9] and owner.tolist() == [0, 0, 0, 1, 1, 0] and c.tolist() == [45, 8, 0, 3, 3, 45]
    assert rest.tolist() == [1, 0] and events.tolist() == [2, 1] and whole.tolist() == [54, 3] and kept.tolist() == [True, True]
    left = rest + events
    p = {1: 0.3, 2: 0.2, 3: 0.1, 4: 0.4}
    assert sum(({1: 45, 2: 8}.get(x, 0) + left[0] * q) / (whole + events)[0] for x, q in p.items()) == pytest.approx(1)


def test_blocks_ask_with_numbers_and_rare_next_words_as_one(spark, tmp_path):
    import numpy as np

    texts = [(k, " ".join(f"a r{k}x{i}" for i in range(9)) + " a b a b") for k in range(100, 140)]
    blocks = stash(suffix_tree.tokenised(docs_of(spark, texts), "doc_id", "text", 5, 1, 1 << 20), str(tmp_path), "blocks")
    answers = [stash(suffix_tree.word_counts(blocks, 3), str(tmp_path), "answers0")]
    joined = suffix_tree.with_answers(blocks, answers)
    assert "vocab" not in joined.columns  # hashes go once, to be counted and numbered
    numbers, c, n, _ = {}, *reference_scores(texts)
    for row in joined.collect():
        walk = suffix_tree.Walk(row.asDict(recursive=True), n, len(c), 3, 1 << 22, 2)
        assert len(np.unique(walk.ids)) == len(walk.ids) == len(np.unique(spread := suffix_tree.spread(walk.ids))) and walk.ids.min() > 0
        assert walk.ids.max() < 2 * 3 * len(c) + 400
        asked = walk.asked(1)
        a = walk.hash[np.argmax(walk.word_count)]
        mine = asked["word"][asked["pair_group"] == np.flatnonzero(asked["context"] == a)[0]]
        assert sorted(mine.tolist())[0] == 0 and len(mine) == 2  # b, and all others as one
        for i, code in zip(walk.ids.tolist(), spread.tolist(), strict=True):
            assert numbers.setdefault(i, code) == code
