import random
import re

from pyspark.sql import functions as F

from quarry.llm import pii, queries

from .conftest import SF, sha


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def plain_spans(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_spans_equal_plain_matching(documents, odd_texts):
    rnd = random.Random(5)
    alphabets = ("ab.@@--_%é", "01.2.5.", "0123 -- ", "+0123 ().-a😀", "a1@.+- é\n")
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 150))) for a in alphabets for _ in range(300)]
    # long runs: no stack overflow, no quadratic time, and more matches than a chunk
    texts += ["1 " * 20_000, "1" * 20_000, "a@b" + ".c" * 20_000, "a" * 200_000, "1." * 30_000, "+1" + " (1)" * 5000,
              "4111111111111111 x" * 3000, "a@b.co_c@d.ee", "0000255.1.1.1 256.1.1.1"]
    rows = odd_texts + [(100 + i, t) for i, t in enumerate(texts)]
    found = pii.find(documents(rows)).select("doc_id", pii.listed(pii.KINDS[:4]).alias("spans"))
    key = lambda x: (x[0] is None, x)
    assert sorted([tuple(r) for r in found.collect()], key=key) == sorted([(i, plain_spans(t)) for i, t in rows], key=key)


def test_em_finds_the_reliable_labelers():
    rnd = random.Random(2)
    counts, wrong = {}, 0
    truth = {}
    for _ in range(3000):
        y = rnd.random() < 0.3
        v = tuple((1 if (rnd.random() < good) == y else -1) if rnd.random() < 0.8 else 0 for good in (0.95, 0.9, 0.9, 0.55))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    reliability, prior, posterior = pii.estimate(sorted(counts.items()))
    assert abs(prior - 0.3) < 0.06
    lift = [t[1][1] / t[1][0] for t in reliability]
    assert lift[0] > lift[3] and lift[3] < 2
    wrong = sum((posterior[v] > 0.5) != y for v, ys in truth.items() for y in ys)
    assert wrong < 0.12 * 3000


def test_secrets_are_found_and_clean_words_are_not(spark):
    rnd = random.Random(6)
    token = lambda n, a="0123456789abcdef": "".join(rnd.choice(a) for _ in range(n))
    texts, planted = [], []
    for i in range(200):
        secret = [f"password={token(18)}", f'token = "{token(40)}"', "AKIA" + token(16, "ABCDEFGHJK234567")][i % 3]
        texts.append(f"word {secret} word")
        planted.append(re.split('[="]', secret.rstrip('"'))[-1].strip())
    clean = ["chapter-twelve1", "http://site.example/aaaaaaaaaaaa11", "wonderfulthings22", "internationalization5"] * 60
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    found = pii.detect(docs).join(docs, "doc_id").select("doc_id", "text", F.explode("secret").alias("s")).collect()
    got = {r.doc_id: r.text[r.s.start:r.s.end] for r in found}
    assert sum(got.get(i) == p for i, p in enumerate(planted)) >= 0.95 * len(planted)
    assert not [r for r in found if r.doc_id >= len(texts)]


def test_edge_cases(documents, odd_texts):
    out = pii.detect(documents(odd_texts))
    assert out.columns == ["doc_id", *pii.KINDS] and out.count() == len(odd_texts)
    assert pii.detect(documents(odd_texts).limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(base) and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in pii.KINDS[:4])
