"""Operators 2, 3, 4, 5, 6 and 9: contracts, round trips, held-out quality and odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op2_pitman_yor, op3_chat, op4_packing, op5_langid, op6_url_filter, op9_sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)


ODD = [(900, None, "en"), (901, "", "en"), (902, "  \n ", None), (903, "12 34", "de"), (None, "the thing", "en"), (904, "a  b\n\n c ", None), (905, " x y\x1c z\t", None), (904, "a  b\n\n c ", None)]


# --- 2: language model


def test_scores_equal_their_contract_and_beat_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(ODD, "doc_id long, text string, lang string"))
    got = op2_pitman_yor.score_texts(docs)
    rows, rest = got[0].collect(), got[1]
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]) for i, t in texts]
    count = Counter(w for i, ws in tokens for w in ws if op2_pitman_yor.training(i))
    n, v = sum(count.values()), len(count)
    assert (rest.tokens, rest.known) == (n, v)
    want = Counter((i, len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    held = [r for r in rows if r.doc_id is not None and not op2_pitman_yor.training(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)


TRAINED, HELD = ([i for i in range(400) if op2_pitman_yor.training(i) == t] for t in (True, False))
SAID = ["the cat sat on the mat", "the cat sat", "a dog sat on the cat", "the the the the the the the", "a b the b a b the b", "cat", "the dog sat on a mat", "on the mat the cat sat"]


def next_word(spark, contexts, words):
    """p(word | context) for each pair, "" for the end, by the scores of two-word texts that are not learned from."""
    rows = [(i, t) for i, t in zip(TRAINED, SAID * 3)]
    asked = [(u, w) for u in contexts for w in words]
    rows += [(i, f"{u} {w}") for i, (u, w) in zip(HELD, asked, strict=False)]
    assert len(asked) <= len(HELD)
    got = {r.doc_id: r.token_scores[1] for r in op2_pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), by_token=True)[0].collect()}
    return {pair: 10 ** got[i] for i, pair in zip(HELD, asked, strict=False)}


@pytest.mark.parametrize("bucket_tokens", [3_000_000, 25])
def test_predictions_of_a_context_sum_to_one(spark, monkeypatch, bucket_tokens):
    monkeypatch.setattr(op2_pitman_yor, "BUCKET_TOKENS", bucket_tokens)  # 25: several buckets, "the" and the end are heavy
    vocabulary = sorted({w for t in SAID for w in t.split()})
    p = next_word(spark, ["the", "dog", "never"], [*vocabulary, "", "unheard"])
    for u in ("the", "dog", "never"):
        assert abs(sum(p[u, w] for w in [*vocabulary, "", "unheard"]) - 1) < 1e-6
    assert p["the", "cat"] > p["dog", "cat"] and p["never", "the"] > p["never", "dog"]


def seated_one_by_one(texts, discount, strength, known, sweeps=600, burn_in=100):
    """Mean p(word | context) of a dense sampler: explicit tables, one customer at a time."""
    rng = random.Random(5)
    (d0, d1), (s0, s1) = discount, strength
    leaf, root, customers = {}, {}, []

    def p0(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root.get(w, [])) - d0 * len(root.get(w, [])) + (s0 + d0 * t) / (known + 1)) / (s0 + n)

    def p1(u, w):
        own = leaf.get(u, {})
        n, t = sum(sum(x) for x in own.values()), sum(len(x) for x in own.values())
        return (sum(own.get(w, [])) - d1 * len(own.get(w, [])) + (s1 + d1 * t) * p0(w)) / (s1 + n)

    def sit(tables, discount, fresh):
        weights = [x - discount for x in tables] + [fresh]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(u, w):
        t = sum(len(x) for x in leaf.setdefault(u, {}).values())
        if sit(leaf[u].setdefault(w, []), d1, (s1 + d1 * t) * p0(w)):
            sit(root.setdefault(w, []), d0, (s0 + d0 * sum(map(len, root.values()))) / (known + 1))

    for t in texts:
        ws = [None, *t.split(), None]
        customers += zip(ws[:-1], ws[1:], strict=True)
    for u, w in customers:
        add(u, w)
    kinds, total = sorted(set(customers), key=str), Counter()
    for k in range(sweeps):
        for u, w in customers:
            if leave(leaf[u][w]):
                leave(root[w])
            add(u, w)
        if k >= burn_in:
            for u, w in kinds:
                total[u, w] += p1(u, w) / (sweeps - burn_in)
    return total


def test_probabilities_are_those_of_a_dense_sampler(spark, monkeypatch):
    monkeypatch.setattr(op2_pitman_yor, "SAMPLES", 12)
    rows = [(i, t) for i, t in zip(TRAINED, SAID * 3)]
    scores, m = op2_pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), by_token=True)
    got = {}
    texts = dict(rows)
    for r in scores.collect():
        ws = [None, *texts[r.doc_id].split(), None]
        got |= {pair: 10**x for pair, x in zip(zip(ws[:-1], ws[1:], strict=True), r.token_scores, strict=True)}
    want = seated_one_by_one([t for _, t in rows], m.discount, m.strength, m.known)
    assert got.keys() == want.keys()
    off = [abs(math.log10(got[k] / want[k])) for k in got]
    assert np.mean(off) < 0.03 and max(off) < 0.2


def test_language_model_of_a_long_text_and_clashing_columns(spark):
    rows = [(TRAINED[0], "x y " * 60_000), (HELD[0], "x y"), (HELD[1], "y y"), (TRAINED[1], "\ue000 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("bucket", "kind", "batch", "part", "score", "w")})
    got = {r.doc_id: r for r in op2_pitman_yor.score_texts(docs)[0].collect()}
    assert (got[TRAINED[0]].n_tokens, got[HELD[0]].n_known) == (120_001, 3)
    assert got[HELD[0]].score > got[HELD[1]].score
    one = op2_pitman_yor.perplexity(op2_pitman_yor.score_texts(docs)[0]).first()
    assert 1 < one.perplexity < one.base_perplexity


def test_seating_opens_as_many_tables_as_one_by_one():
    rng = np.random.default_rng(0)
    fast = op2_pitman_yor.seat(np.full(4000, 30.0), lambda i, k: np.full(len(i), 0.7), 0.4, rng).mean()
    slow = []
    for _ in range(4000):
        t = 1
        for i in range(1, 30):
            t += rng.random() < 0.7 / (0.7 + i - 0.4 * t)
        slow.append(t)
    assert abs(fast - np.mean(slow)) < 0.1


def test_language_model_without_rows_or_training(spark):
    empty = docs_of(spark, [])
    assert op2_pitman_yor.score_texts(empty)[0].count() == 0
    only = next(i for i in range(100) if not op2_pitman_yor.training(i))
    r = op2_pitman_yor.score_texts(docs_of(spark, [(only, "a b", None)]))[0].first()
    assert (r.n_tokens, r.n_known, r.score, r.base_score) == (3, 0, 0.0, 0.0)


# --- 3: chats


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "<|", "<\\\\|x", "", None, "\n", "é<|im_start|>\n", "<<|>"]


@pytest.mark.parametrize("n", [1, 5, 40])
def test_chats_round_trip(spark, n):
    rng = random.Random(n)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "<|x\\", None]), rng.choice(NASTY) if rng.random() < 0.7 else "plain") for c in range(6) for t in range(n)]
    got = {r.conv_id: r for r in op3_chat.digest_chats(op3_chat.format_chats(chats(spark, rows))).collect()}
    for c in range(6):
        own = [(r or "", t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(op3_chat.chat_template(own))


def test_templates_that_rewrite_are_detected(spark):
    counting = lambda turns: f"{len(turns)} turns\n" + op3_chat.chat_template(turns)
    last_only = lambda turns: "".join(f"{r}:{t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))
    for template in (counting, last_only):
        with pytest.raises(op3_chat.Rewritten):
            list(op3_chat.render([("user", "hello"), ("assistant", "hi")], template))
        bad = op3_chat.format_chats(chats(spark, [(1, 0, "user", "hello"), (1, 1, "assistant", "hi")]), template).filter("error IS NOT NULL")
        assert bad.count() == 1
    head = lambda turns: "<s>" + op3_chat.chat_template(turns) if turns else ""
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(100)]
    assert "".join(p for p, _, _ in op3_chat.render(turns, head)) == head(turns)


@pytest.mark.parametrize("after", [10, 30, 200, 300, 700])
def test_a_template_that_rewrites_a_turn_later_on_is_detected(after):
    late = lambda turns: op3_chat.chat_template([(r, "[cut]") if i == 1 and len(turns) > after else (r, t) for i, (r, t) in enumerate(turns)])
    turns = [("user", f"t{i}") for i in range(800)]
    with pytest.raises(op3_chat.Rewritten):
        list(op3_chat.render(turns, late))
    assert "".join(p for p, _, _ in op3_chat.render(turns[:after], late)) == late(turns[:after])


@pytest.mark.parametrize("n", [60, 256, 257, 400, 1500])
def test_pieces_are_those_of_whole_prefixes(n):
    back = lambda turns: "".join(f"<{r} {turns[i - 50][1] if i >= 50 else ''}>{t}</>" for i, (r, t) in enumerate(turns))
    numbered = lambda turns: "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))
    turns = [("user" if i % 3 else "assistant", f"say {i * 7 % 31}") for i in range(n)]
    for template in (back, numbered, op3_chat.chat_template):
        got = list(op3_chat.render(turns, template))
        assert "".join(p for p, _, _ in got) == template(turns)
        assert [p[a:z] for p, a, z in got] == [t for _, t in turns]
        assert [len(p) for p, _, _ in got] == [len(template(turns[: i + 1])) - len(template(turns[:i])) for i in range(n)]


@pytest.mark.parametrize("whole", [None, 256])
def test_a_template_of_single_turns_gives_the_same_with_strides(whole):
    turns = [("user" if i % 3 else "assistant", f"say {i * 7 % 31} <|") for i in range(1100)]
    got = list(op3_chat.render(turns, whole=whole))
    assert [p for p, _, _ in got] == [op3_chat.chat_template([t]) for t in turns]
    assert [op3_chat.unescape(p[a:z]) for p, a, z in got] == [t for _, t in turns]


def test_borders_that_move_at_one_length_are_those_of_whole_prefixes():
    """The separator behind turn 300 comes with turn 301 in one prefix only."""
    late = lambda turns: "".join(f"{t}|" for _, t in turns)[: -1 if len(turns) == 300 else None]
    turns = [("user", f"x{i + 1}") for i in range(400)]
    got = list(op3_chat.render(turns, late))
    assert got[299] == ("x300", 0, 4) and got[300] == ("|x301|", 1, 5) and got[301] == ("x302|", 0, 4)


def test_a_change_that_is_taken_back_is_detected():
    brief = lambda turns: op3_chat.chat_template([(r, "[cut]") if i == 6 and len(turns) in (300, 301) else (r, t) for i, (r, t) in enumerate(turns)])
    with pytest.raises(op3_chat.Rewritten, match="300 turns"):
        list(op3_chat.render([("user", f"t{i}") for i in range(400)], brief))


def test_rows_without_a_conversation_and_extra_columns(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (3, None, "user", "x"), (3, 0, None, "y"), (3, 0, None, "y")]
    extra = chats(spark, rows).withColumns({"piece": F.lit(1), "salt_": F.lit("s"), "error": F.lit("e")})
    got = op3_chat.digest_chats(op3_chat.format_chats(extra)).collect()
    assert sorted((r.conv_id or -9, r.n_turns, r.loss_chars) for r in got) == [(-9, 1, 0), (-9, 1, 1), (-9, 1, 1), (3, 3, 0)]


def test_no_chats(spark):
    assert op3_chat.digest_chats(op3_chat.format_chats(chats(spark, []))).count() == 0


# --- 4: packing


def test_packing_places_each_id_once(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(ODD[:-1], "doc_id long, text string, lang string"))
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*real.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = op4_packing.pack(docs).collect()
    placed: dict = {}
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert np.frombuffer(p.ids, np.uint16).tolist() == ids and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        placed.setdefault(p.doc_id, []).extend(range(p.start, p.start + p.length))
    assert {i: sorted(x) for i, x in placed.items()} == {i: list(range(len(x))) for i, x in want.items()}
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        total = sum(n for _, n in s)
        assert total <= 1024 and total & (total - 1) == 0  # nothing is padded
    assert op4_packing.pack(docs.limit(0)).count() == 0


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(1)
    topics = [rng.choice(50_000, 60) for _ in range(4)]
    tails = [(i, 200, 0, rng.choice(topics[i % 4], 200).astype(np.uint16)) for i in range(40)]
    shard = op4_packing.Shard(tails, np.ones(op4_packing.VOCABULARY))
    assert {int(i) % 4 for i in shard.neighbours(6)[:10]} == {2}
    first = next(iter(shard.windows()))
    assert {p[0] % 4 for p in first} == {0}


def test_scores_are_those_of_plain_bm25():
    rng = np.random.default_rng(2)
    tails = [(i, 50, 0, (rng.zipf(1.3, rng.integers(1, 300)) % 400).astype(np.uint16)) for i in range(60)]
    idf = rng.random(op4_packing.VOCABULARY) * 5
    shard = op4_packing.Shard(tails, idf)
    assert 0 < len(shard.matrix) < 400
    mean, k1, b = np.mean([len(t[3]) for t in tails]), op4_packing.K1, op4_packing.B
    for seed in (0, 17, 59):
        for i, t in enumerate(tails):
            tf = Counter(t[3].tolist())
            want = sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t[3]) / mean)) for w in set(tails[seed][3].tolist()) if w in tf)
            assert abs(shard.scores(seed)[i] - want) < 1e-2


def test_many_null_texts_are_packed_fast_and_odd_columns_pass(spark):
    rows = [(None if i % 3 else i, None if i % 2 else "") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("n", "key", "head", "tail", "df", "ids")})
    began = time.perf_counter()
    pieces = op4_packing.pack(df.coalesce(1)).collect()
    assert time.perf_counter() - began < 20 and sum(p.length for p in pieces) == 6000
    lengths = Counter()
    for p in pieces:
        lengths[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 for n in lengths.values())


def test_ids_are_those_of_the_named_tokenizer_file(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    real, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), op4_packing.Tokenizer(op4_packing.default_tokenizer())
    rng = random.Random(8)
    odd = ["<|endoftext|> hi", "hi <|endoftext|>", "a<|endoftext|><|endoftext|>b \n <|endoftext|>  c", "<|endoftext", "a" * 5000, "  " * 700, "\n" * 900, "\x00\x01\x7f", "<|endoftext|>", "日本語テキスト" * 50, "é́ñ\u200d👩‍👩‍👧 ｆｕｌｌ", "1234567890" * 90, "don't we'LL I'm", "\u00a0\u2003 x\r\n\ty", "…—“”"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2000), rng.randrange(0x3000, 0xD000), rng.randrange(0x10000, 0x1F9FF)])) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts = odd + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t, e in zip(texts, real.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(t).tolist() == [*e.ids, 0]


# --- 5: language ID


def test_numbers_are_no_letters_and_cosines_are_plain(spark):
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(["½ ²", "Ⅷ", "٣ 12", "①", "x½y", "the cat and the dog", "ʰ"])])
    model = op5_langid.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in op5_langid.identify(docs, model).collect()}
    assert [i for i in got if got[i].lang_pred == "und"] == [0, 1, 2, 3]
    v = np.zeros(op5_langid.DIMENSION)
    text = " the cat and the dog "
    for a, b, c in zip(text, text[1:], text[2:]):
        v += np.roll(op5_langid.letter(ord(a)), 2) * np.roll(op5_langid.letter(ord(b)), 1).astype(float) * op5_langid.letter(ord(c))
    cosine = {k: float(p @ v / np.linalg.norm(v)) for k, p in model.items()}
    assert got[5].lang_pred == max(cosine, key=cosine.get) and abs(got[5].score - max(cosine.values())) < 1e-6


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = op5_langid.train(docs)
    out = op5_langid.identify(docs, model).collect()
    held = [r for r in out if op5_langid.held_out(r.doc_id) and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    odd = {r.doc_id: r for r in op5_langid.identify(docs_of(spark, ODD).withColumn("score", F.lit(3)), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (900, 901, 902, 903)) and odd[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in op5_langid.identify(docs_of(spark, ODD), {}).collect()} == {"und"}
    assert op5_langid.train(docs.limit(0)) == {}
    assert op5_langid.identify(docs.limit(0), model).count() == 0
    assert op5_langid.known_language(docs, model).columns == docs.columns


def test_short_texts_of_letters_stay_and_long_random_ones_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op5_langid.train(docs)
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randrange(0x3400, 0x4DB0)) for _ in range(6)) for _ in range(60))
    short = [(1, "Edrere.", "en"), (2, "Reouti anatha.", "en"), (3, "A.", "en"), (4, "Avec.", "fr")]
    odd = docs_of(spark, [*short, (5, noise, "en"), (6, "12 34", "en")])
    assert min(r.score for r in op5_langid.identify(odd, model).collect() if r.doc_id < 5) < op5_langid.FLOOR
    assert sorted(r.doc_id for r in op5_langid.known_language(odd, model).collect()) == [1, 2, 3, 4]
    clash = op5_langid.known_language(odd.selectExpr("*", "'x' AS grams", "7 AS grams_"), model)
    assert clash.columns[-2:] == ["grams", "grams_"] and sorted(clash.select("doc_id", "grams", "grams_").collect()) == [(i, "x", 7) for i in range(1, 5)]


def test_trigram_vectors_bind_by_place():
    def vector(text):
        grams, n = op5_langid.trigrams(text)
        return op5_langid.bundle(grams, n)

    assert list(op5_langid.trigrams("  ")[0]) == []
    a, b = vector("abc"), vector("cba")
    assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) < 0.2
    assert np.array_equal(a, vector("ABC")) and np.array_equal(a, vector("1abc!"))


# --- 6: url filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [
        (1, "http://a.net/x", None), (2, "http://EXAMPLE.net/en/p?q#f", ""), (3, "https://sub.example.net/en/", ""), (4, "http://example.net/de/", ""),
        (5, "http://example.com/de/1", ""), (6, "http://notexample.com/de/1", ""), (7, "http://x.org/fr/1", link("friend.com")), (8, "http://x.org/fr", ""),
        (9, None, None), (10, "no scheme", ""), (11, "http://", ""), (12, "http://shady.com/", link("a.net")), (13, "http://friend.com/y", ""), (14, "http://net/", ""),
        (15, "http://plain.com/", link("plain.com")), (15, "http://plain.com/", None), (16, "http://farm.com/a", link("shady.com")), (17, "http://hostonly.net?x", ""),
    ]
    got = {r.page_id: r for r in op6_url_filter.judge_urls(pages(spark, rows)).collect()}
    rule = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert rule[1] == ("net/", "block") and rule[2] == rule[3] == ("example.net/en/", "allow") and rule[4] == ("net/", "block")
    assert rule[5] == ("example.com/de/", "block") and rule[6][0] is None and rule[7] == ("org/fr/", "allow") and rule[8] == (None, "allow")
    assert (got[9].host, got[9].path, rule[9]) == ("", "", (None, "allow")) and got[10].host == got[11].host == ""
    assert (got[2].host, got[2].path) == ("example.net", "/en/p") and rule[14] == ("net/", "block")
    assert rule[12] == (None, "block") and rule[16] == (None, "block") and rule[13] == (None, "allow") and rule[15] == (None, "allow")
    assert got[13].trust > 0 and got[12].distrust > got[16].distrust > 0
    assert op6_url_filter.judge_urls(pages(spark, rows)).count() == len(rows)
    assert op6_url_filter.judge_urls(pages(spark, [])).count() == 0


def test_rules_and_graph_equal_their_sql(spark):
    """Absolute links, with the case of much trust far away and little distrust nearby, against the SQL."""
    import duckdb

    rng = random.Random(12)
    names = [f"{x}.{top}" for x in "abcdefgh" for top in ("info", "net", "dev")] + ["org", "b.org"]
    link = lambda h: f'<a href="{rng.choice(["http:", "HTTPS:", ""])}//{h}/x">'
    rows = [(i, "http://b.org/fr/", '<a href="http://h.info/">' '<a href="//k.info/">') for i in range(10)]
    rows += [(10, "http://h.info/", '<a href="http://bad.net/">'), (11, "http://bad.net/", None), (12, "http://k.info/", "")]
    rows += [(20 + i, f"https://{rng.choice(names)}/{rng.choice(['', 'fr/', 'en/x', 'p?q'])}", "".join(link(rng.choice(names)) for _ in range(rng.randrange(4)))) for i in range(300)]
    rows += [(400, None, link("a.net")), (401, "no host", None), (402, "http://", link("a.net"))]
    for some in (rows, rows[:13]):
        df = pages(spark, some)
        frame = df.toPandas()
        con = duckdb.connect()
        con.register("pages", frame)
        want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({op6_url_filter.ORACLE})").fetchall())
        got = sorted(tuple(r) for r in op6_url_filter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect())
        assert got == want
        assert some is rows or {r[1]: r[4] for r in got}["h.info"] == "allow"
    assert len({(r[3] is None, r[4]) for r in want}) > 2


def test_verdicts_do_not_depend_on_the_number_of_other_hosts(spark):
    own = pages(spark, [(1, "http://shop.example.com/de/x", ""), (2, "http://shop.example.com/y", ""), (3, "http://other.com/", "")])
    many = spark.range(10, 200_010).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 1000, F.lit(".net/")).alias("url"), F.lit("").alias("html"))
    small, large = ({r.page_id: r.verdict for r in op6_url_filter.judge_urls(df).filter("page_id < 10").collect()} for df in (own, own.union(many)))
    assert small == large == {1: "block", 2: "block", 3: "allow"}


def test_pagerank_equals_dense_iteration(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.host: r.score for r in op6_url_filter.propagate(df, spark.createDataFrame([("d", 0.5), ("b", 0.5)], "host string, seed double")).collect()}
    seed = {"d": 0.5, "b": 0.5}
    rank = dict(seed)
    for _ in range(op6_url_filter.ROUNDS):
        flow = Counter()
        for s, t in edges:
            flow[t] += 0.85 * rank.get(s, 0) / sum(x == s for x, _ in edges)
        rank = {h: flow[h] + 0.15 * seed.get(h, 0) for h in {*flow, *seed}}
    assert all(abs(got[h] - rank[h]) < 1e-12 for h in rank)


# --- 9: sharding


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(50, 2000) + str(i), rng.choice(["en", "de", None]), rng.choice(["a"] * 5 + ["b", "c", None])) for i in range(3000)]
    rows += [(10_000 + i, "copy" * 100, "en", "a") for i in range(1500)] + [(20_000, None, None, None), (20_001, "", None, None), (None, "né", None, None), (5, rows[5][1], "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash"))
    got = op9_sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    slots: dict = {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(size) == 40 and max(size.values()) < 1.1 * sum(size.values()) / 40 and min(size.values()) > 0.9 * sum(size.values()) / 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert op9_sharding.shard_documents(df.limit(0)).count() == 0
    copies = [(1, "same row " * 30, "en", "a")] * 800 + [(i, "y" * 290 + str(i), "en", f"s{i % 90}") for i in range(800)]
    even = Counter()
    for r in op9_sharding.shard_documents(spark.createDataFrame(copies, "doc_id long, text string, lang string, source string")).collect():
        even[r.shard] += r.size
    assert max(even.values()) < 1.1 * sum(even.values()) / 40
    assert {r.shard for r in op9_sharding.shard_documents(df.limit(3)).collect()} <= set(range(40))
