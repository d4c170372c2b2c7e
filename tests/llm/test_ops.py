"""The operators on small tables with every odd case, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.llm import chunk_ids, exact_dedup, ftrl, language_id, near_dedup, quality, queries, secrets, sentencepieces, spaced_seeds, textvec, token_store, toxicity, warc
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = ("digest", "blob", "spans", "key", "node", "label", "n", "keep_id", "score", "kept", "hash", "salt", "votes", "texts", "marks", "shape")


def clashing(df):
    """With columns of those names."""
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def docs(spark, texts):
    rows = [(k, t, None if k % 5 == 4 else "en", None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["a b c d e f", "a b c d e f", None, "", "   ", "A B C D E F", "!!!", "日本語 テキスト", "x" * 50_000, "word " * 20_000, "a b c d e f", "é É ß", "tok\0en", "a"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# --- 8 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")])
def test_exact_groups(odd, digest):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(clashing(odd), digest, salts=3).collect()}
    by = {}
    for k, t in enumerate(ODD):
        by.setdefault(t or "", []).append(k)
    assert len(got) == len(ODD)
    for t, ids in by.items():
        for k in ids:
            assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (max(ids), len(ids), k == max(ids), sha(t))


def test_exact_groups_of_nothing_and_repeats(spark, none):
    assert exact_dedup.exact_groups(none).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_groups(twice).collect()) == [(-1, 3, False), (1, 3, True), (1, 3, True)]


def test_drop_copies_keeps_columns(odd):
    kept = exact_dedup.drop_copies(clashing(odd))
    assert kept.columns == [*odd.columns, *CLASHING] and kept.count() == len({t or "" for t in ODD})


# --- 4 -------------------------------------------------------------------------------------------

SECRETS = [
    "password=abcdef", "PASSWD: 'abc'", "token = token=abcdefgh", "secret=token:abcdefgh", "AKIA" + "B" * 16, "AKIAAKIA" + "C" * 11, "0123456789abcdef01234567", "0123456789abcdef0123456",
    "api_key:" + "x" * 40_000, "é日 token=\"0123456789abcdef0123456789\" ", "Kelvin toKen=abcdef", None, "", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "apikey= abcdef apikey=ghijkl",
]


def test_secrets(spark):
    df = clashing(docs(spark, SECRETS * 2))
    rows = {r.doc_id: r for r in secrets.findings(df).collect()}
    assert len(rows) == 2 * len(SECRETS)
    for k, t in enumerate(SECRETS * 2):
        r = rows[k]
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == brute.base_row(t), t
        base = [f"{brute.BASE[j][0]}:{a}:{b}" for a, j, b in brute.base_spans(t)]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base
    assert "forge:0:40" in rows[13].spans and "pem:0:" in rows[14].spans


def test_ledger_scans_only_what_is_new(spark, tmp_path, none):
    ledger = f"file://{tmp_path}/ledger"
    one = secrets.scan_versions(docs(spark, ["password=abcdef", "x"]), ledger)
    assert one.count() == 2 and secrets.read_ledger(spark, ledger).count() == 2
    two = secrets.scan_versions(docs(spark, ["x", "password=abcdef", "password=abcdef", "new token=abcdefg"]), ledger)
    assert [len(r.spans) for r in two.orderBy("doc_id").collect()] == [0, 1, 1, 1] and secrets.read_ledger(spark, ledger).count() == 3
    assert secrets.scan_versions(docs(spark, ["x"]), ledger, version="2").count() == 1 and secrets.read_ledger(spark, ledger).count() == 4
    assert secrets.findings(none).count() == 0


# --- 1 -------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


def test_warc(spark):
    big, same = "é<p>" * 40_000, "y" * 1000
    rows = [(1, "u", big), (2, "u\n2", same), (3, None, same), (9, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "\r\n\r\n0\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES)
    got = {r.page_id: r for r in warc.round_trip(df, payloads=True).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        raw = (html or "").encode()
        r = got[k]
        assert (r.payload_bytes, r.payload_digest, bytes(r.payload)) == (len(raw), hashlib.sha1(raw).hexdigest(), raw)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if k in (2, 3) else ("response", None))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_segments_out_of_order_and_wrong_totals(spark):
    block = warc._HTTP + warc.framed(b"p" * 9000, 1000)
    parts = [block[a : a + 3000] for a in range(0, len(block), 3000)]
    rows = [("o", k + 1, len(block) if k == len(parts) - 1 else None, p, 1 if k == 0 else None, None, None) for k, p in enumerate(parts)]
    random.Random(1).shuffle(rows)
    schema = "origin string, segment int, total long, block binary, page_id long, url string, digest string"
    assert bytes(warc.reassemble(spark.createDataFrame(rows, schema), True).first().payload) == b"p" * 9000
    for bad in (rows[1:], [(*r[:2], r[2] and r[2] + 1, *r[3:]) for r in rows]):
        with pytest.raises(Exception, match="segments|total length"):
            warc.reassemble(spark.createDataFrame(bad, schema), True).collect()


def test_framing():
    for n in (0, 1, 999, 1000, 1001):
        assert warc.unframed(warc.framed(b"z" * n, 1000)) == b"z" * n
    assert warc.unframed(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            warc.unframed(bad)


# --- 2 and 5 -------------------------------------------------------------------------------------


def mixed_texts(n, seed):
    r = random.Random(seed)
    parts = [" ", "  ", "'s", "'", "a", "don't", "the ", "\n", "\n\n", "　", " ", "é", "É'd", "\0", "😀", "ﬁ", "日本", "\t", "<|endoftext|>", "12", "я", "ª", "×", "3.4", "!!", ", ", " 'tis", "▁", "<s>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("least", [0, 1])
def test_token_store(spark, least):
    from tokenizers import Tokenizer

    texts = [*ODD, *mixed_texts(400, 3), *["same text of a passage " * 200] * 5][least:]
    df = docs(spark, texts).repartition(5)
    rows = {r.doc_id: r for r in token_store.round_trip(df, queries.vocabulary("byte_bpe_50k.json"), with_ids=True).collect()}
    tokenizer, start = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), 0
    tokenizer.encode_special_tokens = True
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert rows[k].ids == ids.tolist()
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store_holds_each_chunk_once_and_tells_damage(spark, tmp_path, none):
    path = f"file://{tmp_path}/store"
    df = docs(spark, ["same words of one passage " * 400] * 6 + ["other words " * 900]).repartition(4)
    token_store.write_store(df, path, queries.vocabulary("byte_bpe_50k.json"))
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == index.select("digest").distinct().count()
    packs = {x.name for x in (tmp_path / "store/packs").iterdir() if x.suffix == ".zst"}
    assert packs == {r.file for r in index.select("file").distinct().collect()}
    token_store.read_store(spark, path).count()
    victim = sorted(packs)[0]
    (tmp_path / "store/packs" / victim).write_bytes(b"\0" * 10)
    with pytest.raises(Exception):
        token_store.read_store(spark, path).collect()
    assert token_store.round_trip(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_cuts_depend_on_the_row_alone():
    table = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    r = np.random.default_rng(0)
    a, b = r.integers(0, 400, 9000), r.integers(0, 400, 5000)
    alone = [list(token_store.cut(x, np.array([0, len(x)]), table))[0] for x in (a, b)]
    both = list(token_store.cut(np.concatenate([a, b]), np.array([0, 9000, 14000]), table))
    assert both[0] == alone[0] and [e - 9000 for e in both[1]] == alone[1]
    assert max(np.diff([0, *alone[0]])) <= token_store.MOST


@pytest.mark.parametrize("table", [1, 10_000])
def test_sentencepiece(spark, table):
    import sentencepiece

    model = queries.vocabulary("piece_bpe_32k.model")
    texts = [*ODD, *mixed_texts(400, 4)]
    rows = {r.doc_id: r for r in sentencepieces.encode_documents(docs(spark, texts), model, table, extra=True).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        ids = sp.encode(t or "")
        r = rows[k]
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), sp.decode(ids))
        assert (r.ids_sha256, r.decoded_sha256) == (sha(",".join(map(str, ids))), sha(sp.decode(ids)))


# --- 6, 3, 9 -------------------------------------------------------------------------------------

SYLLABLES = {"aa": "ba ko li mu ra to".split(), "bb": "sch ung ein er ich".split(), "cc": "eau que ion re é".split()}


def prose(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language(spark):
    r = random.Random(2)
    rows = [(k, prose(r, SYLLABLES[lang], r.randint(3, 60)), lang) for k in range(300) for lang in [r.choice(list(SYLLABLES))]]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (1003, "日", None), (None, "ba ko li", None)]
    df = clashing(spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string"))
    got = {x.doc_id: x for x in language_id.predict_documents(df).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(got[k].lang_pred == lang for k, _, lang in held) >= 0.97 * len(held)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= got[k].score <= 1 for k, _, _ in rows)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in SYLLABLES and got[None].held_out
    nothing = language_id.predict_documents(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in nothing} == {"und"} and len(nothing) == 305


def test_kernel_is_the_share_of_common_ngrams():
    import pyarrow as pa

    from gazette.llm.textvec import utf8

    x = language_id.presence(*utf8(pa.array(["Abc", "abd", "", None])))
    grams = lambda s: {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)}
    a, b = grams("abc"), grams("abd")
    assert language_id.kernel(x, x)[0, 1] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5)
    assert language_id.kernel(x, x)[2, 0] == 0


def labelled(spark, column, good, bad, n=240):
    r = random.Random(3)
    rows = [(k, good(r) if k % 3 else bad(r), int(k % 3 > 0)) for k in range(n)]
    odd = [(n, None), (n + 1, ""), (None, "ba"), (n + 2, "x" * 100_000)]
    df = clashing(spark.createDataFrame([*[(k, t) for k, t, _ in rows], *odd], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, y, 1 - y) for k, _, y in rows] + [(None, None, None), (n + 5, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    return df, labels, {k: y for k, _, y in rows}


def rates(got, truth, flip):
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k in held)
    return sum(got[k].predicted == (1 - truth[k] if flip else truth[k]) for k in held) / len(held)


def test_quality(spark):
    noise = lambda r: " ".join(w + r.choice(("!!", "$$", "%%")) for w in prose(r, SYLLABLES["aa"], 40).split())
    df, labels, truth = labelled(spark, "quality", lambda r: prose(r, SYLLABLES["aa"], 40), noise)
    rows = quality.score_documents(df, labels).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == 244 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in rows)
    assert rates(got, truth, False) >= 0.95
    assert {x.score for x in quality.score_documents(df, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark):
    def bad(r):
        words = prose(r, SYLLABLES["aa"], 40).split()
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(("scumbag", "vequ" + r.choice(SYLLABLES["cc"]), "Moron,")))
        return " ".join(words)

    df, labels, truth = labelled(spark, "toxic", lambda r: prose(r, SYLLABLES["aa"], 40), bad, 600)
    rows = toxicity.score_documents(df, labels).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == 604 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows)
    assert rates(got, truth, True) >= 0.95
    assert {x.predicted for x in toxicity.score_documents(df, labels.limit(0)).collect()} == {0}


def plain_em(votes, known, rounds):
    """The label model text by text: posteriors, rates given the parent's vote, in loops."""
    n, v = votes.shape

    def counts(weights):
        each = [[sum(w[y] for w in weights), [sum(w[y] for w, r in zip(weights, votes) if r[i]) for i in range(v)], [[sum(w[y] for w, r in zip(weights, votes) if r[i] and r[j]) for j in range(v)] for i in range(v)]] for y in (0, 1)]
        return toxicity.Counts(*(np.array(x, float) for x in zip(*each)))

    def posterior(model, row):
        p = [1 - model.prior, model.prior]
        for i in range(v):
            for y in (0, 1):
                rate = model.rates[y, i, int(row[model.parent[i]])]
                p[y] *= rate if row[i] else 1 - rate
        return p[1] / sum(p)

    start = counts([(1 - y, y) for y in known])
    model = toxicity.LabelModel.of(start, np.mean(known))
    for _ in range(rounds):
        weights = [(1 - q, q) for q in (posterior(model, r) for r in votes)]
        model = toxicity.LabelModel.of(start + counts(weights).scaled(start.texts), sum(w[1] for w in weights) / n)
    return [posterior(model, r) for r in votes]


def test_label_model_is_plain_expectation_maximisation(spark):
    r = np.random.default_rng(1)
    y = r.random(120) < 0.3
    good = [np.where(r.random(120) < 0.8, y, r.random(120) < 0.05) for _ in range(3)]
    votes = np.stack([*good, good[0] ^ (r.random(120) < 0.03), good[0]], 1).astype(bool)
    known = (y ^ (r.random(120) < 0.05)).astype(float)
    bits = votes @ (1 << np.arange(5))
    unique, n = np.unique(bits, return_counts=True)
    patterns = spark.createDataFrame([(int(b), int(k)) for b, k in zip(unique, n)], "votes long, texts long").repartition(3)
    start = toxicity.Counts.of(votes, np.ones(120), known)
    model = toxicity.LabelModel.fit(start, toxicity.expected(patterns, 5), rounds=3)
    assert model.posterior(votes) == pytest.approx(plain_em(votes, known, 3), abs=1e-9)
    assert ((model.informed(votes, known == 1) > 0.5) == y).mean() > 0.9
    # A copy of a voter hangs on it and says nothing more.
    tied = {frozenset((i, int(p))) for i, p in enumerate(model.parent) if i != p}
    assert frozenset((0, 4)) in tied


def test_toxic_marks_and_shapes_depend_on_the_row_alone():
    import pyarrow as pa

    texts = ["f*ck off", "", "*", "a*", "b NO NO NO NO NO NO NO NO NO NO", "!!", "!", "!!! é*e", None, "wow wow wow wow"]
    alone = [toxicity.shapes(*textvec.utf8(pa.array([t], pa.string())))[0].tolist() for t in texts]
    assert toxicity.shapes(*textvec.utf8(pa.array(texts))).tolist() == alone
    assert [k for k, x in enumerate(alone) if x[0]] == [0] and alone[4][1] and [k for k, x in enumerate(alone) if x[2]] == [7]


def test_quality_weights_are_plain_ftrl():
    r = random.Random(5)
    rows = [(np.array(sorted(r.sample(range(1, 30), 6))), np.array([r.random() for _ in range(6)]), float(r.random() < 0.5)) for _ in range(50)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.01
    z, n = [0.0] * 30, [0.0] * 30

    def weight(c):
        cut = l1 if c else 0.0
        return 0.0 if abs(z[c]) <= cut else ((1 if z[c] > 0 else -1) * cut - z[c]) / ((beta + n[c] ** 0.5) / alpha + l2)

    for _ in range(3):
        for columns, values, y in rows:
            x = {0: 1.0} | dict(zip(columns.tolist(), values.tolist()))
            w = {c: weight(c) for c in x}
            p = 1 / (1 + np.exp(-sum(w[c] * x[c] for c in x)))
            for c in x:
                g = (p - y) * x[c]
                s = ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) / alpha
                z[c], n[c] = z[c] + g - s * w[c], n[c] + g * g
    assert ftrl.fit(rows, 30) == pytest.approx([weight(c) for c in range(30)], abs=1e-12)


def test_language_weights_solve_the_ridge():
    r = np.random.default_rng(4)
    sets = (r.random((40, language_id.COLUMNS)) < 0.02).astype(np.float32)
    langs = ["aa", "bb", "bb", "cc"] * 10
    m = language_id.Model.fit(langs, sets, landmarks=3, ridge=1e-2)
    names = sorted(set(langs))
    chosen = [k for c in names for k in [k for k, x in enumerate(langs) if x == c][:3]]
    size = lambda a: max(1.0, float(a.sum()))
    k = lambda a, b: float((a * b).sum()) / (size(a) * size(b)) ** 0.5
    gram = np.array([[k(a, sets[j]) for j in chosen] for a in sets])
    root = np.linalg.cholesky(np.array([[k(sets[i], sets[j]) for j in chosen] for i in chosen]) * 1e-2 * 40 + 1e-9 * np.eye(len(chosen))).T
    for c, name in enumerate(names):
        w = np.sqrt([40 / (3 * langs.count(x)) for x in langs])
        target = np.array([1.0 if x == name else -1.0 for x in langs])
        # Least squares with the ridge as further rows.
        solved = np.linalg.lstsq(np.vstack([gram * w[:, None], root]), np.concatenate([target * w, np.zeros(len(chosen))]), rcond=None)[0]
        assert m.weights[:, c] == pytest.approx(solved, abs=1e-3)
    assert (m.landmarks == sets[chosen]).all()


# --- colliding words, odd rows, settings ---------------------------------------------------------------


def colliding():
    """Two words of 1,024 letters that every polynomial of their bytes modulo a power of two confuses."""
    bits = [0]
    for _ in range(10):
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_colliding_words_keep_their_own_ids_and_links(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = colliding()
    texts = [one, two, f"x {one} y", f"x {two} y", f"{one} {two} " * 3]
    df = docs(spark, texts)
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model")), Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in sentencepieces.encode_documents(df, queries.vocabulary("piece_bpe_32k.model"), extra=True).collect()}
    assert [(got[k].ids, got[k].decoded) for k in range(5)] == [(sp.encode(t), t) for t in texts]
    got = {r.doc_id: r for r in token_store.round_trip(df, queries.vocabulary("byte_bpe_50k.json"), with_ids=True).collect()}
    assert [got[k].ids[:-1] for k in range(5)] == [bpe.encode(t).ids for t in texts]
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, near_dedup.Rule(3, 85)).collect()}
    assert [groups[k] for k in range(5)] == [0, 1, 2, 3, 4]
    bench = spark.createDataFrame([(0, f"{one} p q r {one}")], "item_id long, text string")
    hit = docs(spark, [f"{two} p q r {two}", f"{one} p q r {one}"])
    assert [r.doc_id for r in spaced_seeds.contaminated(hit, bench).collect()] == [1]


@pytest.mark.parametrize("name", ["bpe", "pieces"])
def test_tables_compare_bytes_when_hashes_meet(monkeypatch, name):
    import pyarrow as pa

    monkeypatch.setattr(chunk_ids, "span_hashes", lambda data, a, b: textvec.span_hashes(data, a, b) % np.uint64(7))
    coder = chunk_ids.ChunkIds(queries.vocabulary("byte_bpe_50k.json")) if name == "bpe" else sentencepieces.Codec(queries.vocabulary("piece_bpe_32k.model"))
    for texts in (["the cat sat", "on a mat", ""], ["another text entirely", "the cat"], mixed_texts(30, 9)):
        ids, at = coder.encode(*textvec.utf8(pa.array(texts)))
        plain = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)] if name == "bpe" else coder.processor.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == plain


def test_long_runs_of_words_stay_bounded():
    import time

    import pyarrow as pa

    block = spaced_seeds.Block.of([7], ["a " * 2000], spaced_seeds.MASKS)
    for text in ("a " * 16_000, "a b " * 8000, "a a a a x " * 3000):
        data, offsets = textvec.utf8(pa.array([text]))
        words, _, bounds = textvec.words_of(textvec.lower_latin(data), offsets, textvec.ALNUM)
        began = time.perf_counter()
        found = list(block.find(words, bounds, spaced_seeds.MASKS, 13))
        assert time.perf_counter() - began < 2 and bool(found) == ("b" not in text)


def test_runs_against_brute_force(spark):
    items = ["a " * 30, "a b " * 12, "one two three four", "a a a a a b", "x y z"]
    texts = ["a " * 50, "q " + "a b " * 30, "p one two three four q", "one two four three", "a a a a a a b b", "b a " * 9, "x y z", "a b c " * 20]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in spaced_seeds.contaminated(docs(spark, texts), bench).collect()}
    assert got == plain_overlaps(texts, items, spaced_seeds.LEAST) and (2, 2) in got


def test_a_crowded_bucket_is_not_paired(spark):
    n = 5000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(100).cast("long").alias("n"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long"), F.col("id") + 10).alias("bands"))
    shared = nodes.select("node", F.explode(F.slice("bands", 1, 4)).alias("key")).withColumn("head", F.lit(0).cast("long"))
    none = spark.createDataFrame([], "node long, label long")
    rule = near_dedup.Rule(3, 85)
    assert rule.shared == 4 and near_dedup.Rule(5, 80).shared == 2
    assert near_dedup.open_nodes(nodes, shared, none, rule).count() == n
    one = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("label"))
    assert near_dedup.open_nodes(nodes, shared, one, rule).count() == 0


ODD_IDS = [(1, "password=abcdef the cat sat on the mat"), (1, "password=abcdef the cat sat on the mat"), (1, "another text for the same id"), (None, "a text without an id"), (None, None), (2, "")]


@pytest.mark.parametrize("rows", [[], ODD_IDS])
def test_each_operator_takes_empty_tables_repeats_and_clashing_names(spark, rows):
    df = clashing(spark.createDataFrame([(*r, "en", "s", None) for r in rows], DOCS)).withColumn("meta.lang", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("of_blob", F.lit(3))
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASHING, "`meta.lang`")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "item_id long, text string")
    n = len(rows)
    found = {
        1: warc.round_trip(pages), 2: token_store.round_trip(df, queries.vocabulary("byte_bpe_50k.json")), 3: quality.score_documents(df, labels), 4: secrets.findings(df),
        5: sentencepieces.encode_documents(df, queries.vocabulary("piece_bpe_32k.model")), 6: language_id.predict_documents(df), 7: near_dedup.near_groups(df), 8: exact_dedup.exact_groups(df),
        9: toxicity.score_documents(df, labels),
    }
    assert {k: x.count() for k, x in found.items()} == dict.fromkeys(found, n)
    for k, x in found.items():
        assert sorted(((r[0] is None, r[0]) for r in x.collect()), key=str) == sorted(((r[0] is None, r[0]) for r in rows), key=str), k
    assert spaced_seeds.contaminated(df, bench).count() == (2 if rows else 0)
    assert [r.base_sha256 for r in found[4].where("doc_id IS NULL").collect()] == [sha("")] * (2 if rows else 0)
    kept = spaced_seeds.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == (["", "", "a text without an id"] if rows else [])
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == (sorted([(1, ODD_IDS[0][1]), (1, ODD_IDS[2][1]), (2, ""), (0, "a text without an id")]) if rows else [])
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == n


def test_drop_copies_goes_by_id_and_text(spark):
    rows = [(5, "A", 1), (5, "B", 2), (9, "A", 3), (7, "C", 2), (7, "C", 1), (None, "D", 1), (None, "D", 2), (None, "A", 1)]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, v int"))
    assert sorted((r.text, r.doc_id or 0, r.v) for r in kept.collect()) == [("A", 9, 3), ("B", 5, 2), ("C", 7, 1), ("D", 0, 1)]


def test_a_caller_keeps_blob_and_spans(spark, tmp_path):
    mine = spark.createDataFrame([(1, "password=abcdef", "mine", 4)], "doc_id long, text string, blob string, spans int")
    row = secrets.scan_versions(mine, f"file://{tmp_path}/ledger").first()
    assert (row.blob, row.spans, row.blob_, [s.end for s in row.spans_]) == ("mine", 4, sha("password=abcdef"), [15])


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for said in ("64m", "67108864b", "1g", "3mb"):
            spark.conf.set(key, said)
            assert quality.score(docs(spark, ["a"]), np.zeros(quality.COLUMNS, np.float32)).count() == 1
            assert spark.conf.get(key) == said
    finally:
        spark.conf.set(key, before)
    assert [textvec.byte_setting(x) for x in ("64m", "67108864b", "1g", "3mb", "12", "2k")] == [64 << 20, 64 << 20, 1 << 30, 3 << 20, 12, 2048]


def test_many_secrets_in_a_text(spark):
    text = "password=abcdef é " * 3000
    row = secrets.findings(docs(spark, [text])).first()
    assert [row.n_assign, row.n_access, row.n_hex, row.base_sha256] == brute.base_row(text)


def test_archives_say_what_other_readers_need(spark, tmp_path):
    big = "é<p>" * 40_000
    df = spark.createDataFrame([(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small")], "page_id long, url string, html string")
    files = warc.write_archives(df, f"file://{tmp_path}/w")
    records = []
    for r in files.collect():
        with open(f"{tmp_path}/w/{r.file}", "rb") as f:
            records += [h for h, _ in warc.read_members(f)]
    by = {h["warc-record-id"]: h for h in records}
    assert len(by) == len(records) and all("warc-target-uri" in h for h in records)
    revisit = next(h for h in records if h["warc-type"] == "revisit")
    assert by[revisit["warc-refers-to"]]["x-page-id"] == "2" and revisit["warc-refers-to-target-uri"] == "http://a/2"
    assert {h["warc-target-uri"] for h in records if h["warc-type"] == "continuation"} == {"http://a/2"}
    twice = warc.round_trip(df.unionByName(df))
    assert twice.count() == 6 and {r.url for r in twice.collect()} == {"http://a/1", "http://a/2", None}
    with pytest.raises(warc.ArchiveError):
        warc.unframed(b"3\r\nabc\r\n0\r\n")


# --- 10 ------------------------------------------------------------------------------------------


def plain_overlaps(texts, items, least):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t or ""))
    out = set()
    for d, t in enumerate(texts):
        for i, s in enumerate(items):
            w, v = words(t), words(s)
            need = min(least, len(v))
            if len(v) < spaced_seeds.SHORTEST:
                continue
            for shift in range(-len(v), len(w)):
                eq = [w[k + shift] == v[k] for k in range(len(v)) if 0 <= k + shift < len(w)]
                if any(sum(eq[a:b]) * 10 >= 8 * (b - a) for a in range(len(eq)) for b in range(a + need, len(eq) + 1)):
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_spaced_seeds(spark, block):
    r = random.Random(8)
    items = [prose(r, SYLLABLES["aa"], n) for n in (5, 8, 13, 14, 15, 20, 40, 4, 1)] + [None, ""]
    texts = [None, "", "   "]
    for s in items[:7] * 12:
        words = s.split()
        for k in r.sample(range(len(words)), int(len(words) * r.choice((0, 0.1, 0.2, 0.25)))):
            words[k] = "zz" + str(r.randrange(1000))
        texts.append(prose(r, SYLLABLES["bb"], 6) + " " + " ".join(words).upper() + ". " + prose(r, SYLLABLES["cc"], 6))
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in spaced_seeds.contaminated(clashing(docs(spark, texts)), bench, block=block).collect()}
    assert got == plain_overlaps(texts, items, spaced_seeds.LEAST)
    assert spaced_seeds.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------


def plain_groups(texts, rule):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = rule.words
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= rule.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def near_texts(seed):
    """Families whose members differ in a few words, so that similarities lie on both sides of the threshold."""
    r, out = random.Random(seed), [t for t in ODD if len(t or "") < 40_000]
    passage = prose(r, SYLLABLES["cc"], 30)
    for _ in range(6):
        base = prose(r, SYLLABLES["aa"], r.choice((2, 4, 12, 80, 200))).split()
        for _ in range(r.choice((2, 5, 25))):
            words = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 4, 8))):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            out.append(" ".join(words).title() if r.random() < 0.3 else " ".join(words))
    return out + [passage + " " + prose(r, SYLLABLES["bb"], r.choice((3, 10))) for _ in range(40)]


@pytest.mark.parametrize(("seed", "rule"), [(1, near_dedup.Rule(3, 85)), (2, near_dedup.Rule(5, 80)), (3, near_dedup.Rule(3, 85))])
def test_near_groups(spark, seed, rule):
    texts = near_texts(seed)
    got = {r.doc_id: r for r in near_dedup.near_groups(clashing(docs(spark, texts)), rule).collect()}
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(texts))] == plain_groups(texts, rule)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_groups_of_nothing(spark, none):
    assert near_dedup.near_groups(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(odd).collect()), key=str)
    assert rows.count((1, 1, True)) == 2 and (2, 2, True) in rows and len(rows) == 4


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    a = np.sort(r.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate([a[:3600], r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
    x, y = near_dedup.registers_of(a), near_dedup.registers_of(b)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - truth) < 0.15 and (near_dedup.registers_of(a[:0]) == 0).all()
