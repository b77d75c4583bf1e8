"""Decontamination, SimHash, toxicity, secrets and sharding against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from curvespark.llm import decontamination, secrets, sharding, simhash, toxicity

WORDS = [f"w{k:02d}" for k in range(40)]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, passage in items:
            own = words_of(passage)
            width = min(13, len(own))
            windows = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if own else set()
            for k in range(len(words) - width + 1):
                if tuple(words[k : k + width]) in windows:
                    hit.update(range(k, k + width))
                    found.add(str(item) if item is not None else "")
        out.append((doc_id, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    passages = [text(30), text(13), text(20), "short item", "one", "", None, "Über café ﬁve", text(14)]
    items = [(k, p) for k, p in enumerate(passages)] + [(2, text(15)), (None, text(16))]
    docs = [(1, None), (2, ""), (3, passages[0].upper()), (4, text(50) + "!" + passages[1] + " " + passages[2]), (5, "a short, ITEM here; one"), (5, "a short, ITEM here; one"), (6, " ".join(items[10][1].split()[1:14]))]
    docs += [(7, " ".join(passages[0].split()[:12])), (8, "über CAFÉ ﬁve x"), (None, passages[8]), (9, (text(70_000) + " " + passages[0] + " ") * 2), (10, passages[0] + " " + passages[0])]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, row long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(frame, bench).collect()
    got = sorted([(None if r.doc_id is None else int(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in found], key=str)
    assert got == contaminated(docs, items)
    for few in (decontamination.find_contamination(frame.limit(0), bench), decontamination.find_contamination(frame, bench.limit(0)).where("n_hit > 0")):
        assert few.count() == 0


def test_decontamination_without_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("concat('x ', id, ' a b c d e f g h i j k l m n ', id)").alias("text"))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    rows = decontamination.find_contamination(docs, bench).collect()
    assert len(rows) == 40 and all(r.n_hit == 13 and r.n_words == 17 for r in rows)


def test_drop_contaminated(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i j k l m", "z"), (1, "clean", "z"), (None, None, None)], "doc_id long, text string, row string").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    kept = decontamination.drop_contaminated(spark.read.parquet(str(tmp_path / "d")), bench)
    assert kept.columns == ["doc_id", "text", "row"] and sorted(kept.collect(), key=str) == sorted([(1, "clean", "z"), (None, None, None)], key=str)


def brute_groups(prints):
    low = {f: f for f in prints}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 4:
                low[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in prints}


def test_simhash_fingerprint():
    import xxhash

    text = "The Quick  brown\tfox É jumps over\nthe lazy dog the quick brown fox"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.simhash(text) == want
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0
    assert simhash.simhash("A b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("refine", [1 << 40, 1])
def test_links_of_fingerprints(spark, monkeypatch, refine):
    monkeypatch.setattr(simhash, "REFINE_ABOVE", refine)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 40)} | {0}
    for base in list(prints)[:20]:
        for flips in (1, 2, 3, 4, 5, 4):
            near = base
            for bit in rng.choice(64, flips, replace=False):
                near ^= 1 << int(bit)
            prints.add(near)
            base = near if flips == 4 else base
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {r.fp % (1 << 64): r.component % (1 << 64) for r in simhash.link_fingerprints(spark.createDataFrame(signed, "fp long")).collect()}
    parts = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert parts(got) == parts(brute_groups(sorted(prints)))


def test_simhash_groups_and_keep(spark, tmp_path):
    long = " ".join(WORDS * 3)
    rows = [(5, long), (3, long), (3, long), (9, None), (8, ""), (1, "else entirely other words here"), (None, long)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted(simhash.simhash_groups(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (1, 1), (None, 3)], key=lambda x: str(next(g for g in got if (g.doc_id, g.component_id) == x)))
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 == simhash.keep_one_of_each_group(docs.limit(0)).count()


@pytest.mark.parametrize("refine", [8_000_000, 0])
@pytest.mark.parametrize("groups", ["simhash_groups", "keep_one_of_each_group"])
def test_simhash_sorts_its_variants_and_broadcasts_none(spark, monkeypatch, refine, groups):  # round 4, F1 and F2
    """Spark sees a 64th of the variants' size, so a join on them would be a broadcast beyond any driver's memory."""
    monkeypatch.setattr(simhash, "REFINE_ABOVE", refine)
    plans, store, connect = [], simhash.stored, simhash.connected_components
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(simhash, "stored", lambda df, name="table": store(seen(df), name))
    monkeypatch.setattr(simhash, "connected_components", lambda edges, *ends: connect(seen(edges), *ends))
    docs = spark.createDataFrame([(k, f"a b c d e f g {k // 2}") for k in range(20)], "doc_id long, text string")
    out = getattr(simhash, groups)(docs)
    if groups == "simhash_groups":
        seen(out)
        assert {(r.doc_id, r.component_id) for r in out.collect()} >= {(k, k // 2 * 2) for k in (0, 1)}
    exploded = [x for x in plans if "Generate explode" in x and "Join" in x]
    assert len(exploded) == (3 if groups == "simhash_groups" else 2) and not any("Broadcast" in x for x in exploded)
    assert groups != "simhash_groups" or not any("Broadcast" in x for x in plans)


def test_simhash_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: simhash.simhash(r.text) for r in docs.collect()}
    groups = brute_groups(sorted(set(prints.values())))
    least = {}
    for k, p in prints.items():
        least[groups[p]] = min(least.get(groups[p], k), k)
    got = simhash.simhash_groups(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{p:016x}", least[groups[p]]) for k, p in prints.items()} and len(got) == len(prints)


def test_toxicity_on_labels_that_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = toxicity.held_out()
    model = toxicity.fit(docs, labels.where(~unseen))
    held = labels.where(unseen & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    rows = toxicity.with_scores(docs.join(F.broadcast(held), "doc_id").select("doc_id", "text", "toxic"), model).collect()
    hit = sum(r.score >= toxicity.THRESHOLD and r.toxic == 1 for r in rows)
    assert len(rows) > 500 and hit >= 0.95 * sum(r.score >= toxicity.THRESHOLD for r in rows) and hit >= 0.9 * sum(r.toxic for r in rows)


def test_toxicity_of_long_tokens_takes_linear_time(spark):
    model = toxicity.character_model(spark.createDataFrame([("the house stands near the river",)], "text string"))
    start = time.process_time()
    assert len(toxicity.decode("a1" * 50_000, model)) > 50_000 and len(toxicity.restore("1d10t " + "x" * 300_000, model)) > 5
    assert time.process_time() - start < 30


def test_toxicity_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (1, "fine")] * 10 + [(k, "fine words") for k in range(2, 50)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k == 1)) for k in range(1, 50)], "doc_id long, toxic int"))
    assert 0 <= model.score("you idiot") <= 1


def test_toxicity_restores_and_scores(spark):
    rng = np.random.default_rng(5)
    clean = ["the house stands near the river", "a letter came this morning", "they planted trees along the road", "idle words and idioms are not idiotic things", "people read stories about stupor and stupas"]
    docs, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        said = [str(rng.choice(clean)) for _ in range(4)] + ([str(rng.choice(["idiot", "stupid"]))] if toxic else [])
        docs.append((k, " ".join(rng.permutation(said))))
        labels.append((k, int(toxic)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    assert toxicity.restore("1d10t  STUUUPID i d i o t", model.characters) == "idiot stupid idiot"
    tests = [(1, "you idiot"), (2, "1d10t"), (3, "so stuuupiiid"), (4, "the river road"), (5, None), (6, ""), (7, "x" * 200_000), (None, "an i d i o t"), (1, "you idiot")]
    scored = toxicity.with_scores(spark.createDataFrame([(*t, 0.5) for t in tests], "doc_id long, text string, score double"), model).collect()
    assert len(scored) == 9 and all(0 <= r.score <= 1 for r in scored)
    assert {r.text for r in scored if r.score >= toxicity.THRESHOLD} == {"you idiot", "1d10t", "so stuuupiiid", "an i d i o t"}
    assert toxicity.with_scores(frame.limit(0), model).count() == 0
    nothing = toxicity.fit(frame, known.limit(0))
    assert {r.score for r in toxicity.with_scores(frame, nothing).select("score").distinct().collect()} == {0.0}
    assert toxicity.fit(frame.limit(0), known).features == {}


def test_held_out(spark):
    got = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"


def test_secrets_are_found_and_masked(spark):
    def doc(k):
        key = hashlib.sha1(str(k).encode()).hexdigest()
        return [f'text token = "{key}" more', f"mail me at user.{k}@mail{k}.example.com today", f"number 4{key[:0]}{10**15 + k} here", f"commit {key} fixed"][k % 4]

    docs = [(k, doc(k), "src") for k in range(400)]
    odd = [(1000, None, None), (1001, "", None), (1002, f'TOKEN = "{KEY.upper()}" and é {KEY}', "s"), (1002, f'TOKEN = "{KEY.upper()}" and é {KEY}', "s"), (None, "password: hunter2!x", "s"), (1003, "y" * 100_000 + " 12", "s")]
    frame = spark.createDataFrame([(*d, 7) for d in docs + odd], "doc_id long, text string, source string, start int")
    found = secrets.scan_secrets(frame).collect()
    texts = {d: t for d, t, _ in docs + odd}
    by = {hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.secret_sha256 for r in found}
    assert by == {True}
    kinds = defaultdict(set)
    for r in found:
        if r.doc_id is not None and r.doc_id < 400:
            kinds[r.doc_id % 4].add(r.is_secret)
    assert kinds[0] == {True} and kinds[1] == {False} and kinds[2] == {False} and kinds[3] == {False}
    masked = {(r.doc_id, r.text) for r in secrets.redact_secrets(frame).collect()}
    assert (0, 'text token = "[SECRET]" more') in masked and (1, docs[1][1]) in masked and (1000, None) in masked and (1001, "") in masked
    assert secrets.redact_secrets(frame).columns == frame.columns
    clash = frame.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(("source", "__before", "__found", "__parts", "row", "c"))))
    assert {(r.doc_id, r.text) for r in secrets.redact_secrets(clash).collect()} == masked and secrets.redact_secrets(clash).columns == clash.columns
    assert secrets.scan_secrets(frame.limit(0)).count() == 0


def pem(lines, headers="", end="\n"):
    body = end.join(hashlib.sha256(str(k).encode()).hexdigest() + "/a/" for k in range(lines))
    return f"-----BEGIN RSA PRIVATE KEY-----{end}{headers}{body}{end}-----END RSA PRIVATE KEY-----"


def test_private_keys_are_masked_whole(spark):
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
    keys = [pem(20), pem(400), pem(5, headers), pem(20, end="\\n")]
    texts = [f"{before}{key}{after}" for key in keys for before, after in (('private_key = "', '" more'), ("secret: ", " more"), ("a ", ", more"))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(frame, source_col=None).collect()}
    for k, text in enumerate(texts):
        key = keys[k // 3]
        assert got[k].replace(" ", "") == text.replace(key, "[SECRET]").replace(" ", "")


def test_candidates_see_the_text_around_them(spark):
    texts = [f"Authorization: Bearer {KEY}", f'é 4000000000000000 token {KEY} "', f"token {KEY} {KEY[::-1]} end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.doc_id, r.x.c, r.x.f) for r in secrets._with_candidates(frame, "text", F.lit("")).select("doc_id", F.explode("__found").alias("x")).orderBy("doc_id", "x.c.start").collect()]
    assert [(k, c.value) for k, c, _ in found] == [(0, KEY), (1, "4000000000000000"), (1, KEY), (2, KEY), (2, KEY[::-1])]
    assert found[0][1].assigned and found[0][2].keyword_left == 1 and found[0][2].letter_digit > 0.3
    for k, c, _ in found:
        before, after = texts[k][: c.start], texts[k][c.start + len(c.value) :]
        assert before.endswith(c.left) and len(c.left) >= min(40, len(before)) and c.right == after[:24]


def test_signs_are_those_of_the_plain_pattern(spark):
    plain = re.compile(rf"(?i:{secrets._KEYWORDS})[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}[\"']?([^\s\"'|]{{6,}})")
    texts = [f"{name}{left}{sign}{right}hunterxy z" for name in ("password", "api_key", "colour") for left in ("", " ", '" ') for sign in (":", "=", "::", "=:", ":=", "==", "=>", "::>", ":>") for right in ("", " ", ' "', '"')]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x.c.value for x in r.found] for r in secrets._with_candidates(frame, "text", F.lit("")).select("doc_id", F.col("__found").alias("found")).collect()}
    assert got == {k: plain.findall(text) for k, text in enumerate(texts)}


def test_forest_sql_is_the_forest(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(x) for x in rng.random(len(secrets.FEATURES))) for _ in range(300)]
    frame = spark.createDataFrame([(float(r[0] + r[3] > 1), r) for r in rows], "label double, f struct<" + ",".join(f"{k}:double" for k in secrets.FEATURES) + ">")
    model = secrets.fit_model(frame)
    wide = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(frame.select("label", "f", "f.*"))
    got = model.transform(wide).select("label", F.expr(secrets.forest_sql(model)).alias("s"), vector_to_array("probability")[1].alias("p")).collect()
    assert all(abs(r.s - r.p) < 1e-12 for r in got) and len({r.s for r in got}) > 20
    assert sum((r.s >= 0.5) == (r.label == 1) for r in got) > 285
    assert secrets.fit_model(frame.where("label = 1")) is None


def test_secrets_of_whole_documents(spark):
    """The given documents hold keys as ``token = "..."``, beside card numbers, mail addresses, hosts and phone numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    truth = {(k, m.start(1), 40) for k, text in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}
    found = secrets.scan_secrets(docs).collect()
    said = {(r.doc_id, r.start, r.length) for r in found if r.is_secret}
    assert len(truth) > 100 and len(found) > 2 * len(truth)
    assert len(said & truth) >= 0.99 * len(truth) and len(said & truth) >= 0.97 * len(said)


def test_forest_on_findings_that_it_has_not_seen(spark):
    found = secrets._each(secrets._with_candidates(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "text", F.col("source")).select("doc_id", "__found"))
    labelled = secrets.label_findings(found.select("doc_id", "x.c", "x.f")).cache()
    held = F.col("doc_id") % 4 == 0
    score = secrets.forest_sql(secrets.fit_model(labelled.where(~held)))
    rows = labelled.where(held).select("label", F.expr(score).alias("s")).collect()
    hit = sum(r.s >= 0.5 and r.label == 1 for r in rows)
    assert len(rows) > 100 and hit >= 0.97 * sum(r.label for r in rows) and hit >= 0.97 * sum(r.s >= 0.5 for r in rows)


def test_secrets_beside_control_characters(spark):
    texts = [f"\x01 a token = \"{KEY}\" \x02\x03\x04 b", "\x03\x05 none", f"\x02{KEY}\x01\x03{KEY}\x02"]
    texts += [" ".join(f"{k:016d}" for k in range(10**15, 10**15 + 3000)) + f' token = "{KEY}"']  # many candidates
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = "CASE WHEN f.letter_digit > 0 THEN 1.0D ELSE 0.0D END"
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(frame, source_col=None, forest=rule).collect()}
    assert masked == {k: t.replace(KEY, "[SECRET]") for k, t in enumerate(texts)}
    found = secrets.scan_secrets(frame, source_col=None, forest=rule).collect()
    assert len(found) == 3004 and all(hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.secret_sha256 for r in found)


def brute_shards(rows, shards, seed):
    by = defaultdict(list)
    for doc_id, text, source in rows:
        data = (text or "").encode()
        h = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        by[source].append((h, -1 if doc_id is None else doc_id, zlib.crc32(data), len(data) + 1))
    line = []
    for source, own in by.items():
        own.sort()
        line += [((2 * k + 1) / (2 * len(own)), source is not None, source or "", r) for k, r in enumerate(own)]
    line.sort(key=lambda x: (x[0], not x[1], x[2], x[3]))
    out, slots = [], defaultdict(int)
    for place, (_, _, _, (_, doc_id, crc, size)) in enumerate(line):
        s = place * shards // len(line)
        out.append((doc_id, size, crc, s, slots[s]))
        slots[s] += 1
    return sorted(out)


@pytest.mark.parametrize(("n", "ranges"), [(997, 13), (997, 1), (5, 4), (1, 1)])
def test_shards(spark, n, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        check_shards(spark, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_shards(spark, n):
    rows = [(k, None if k % 50 == 7 else f"text é {k % 9}", "hot" if k % 3 else f"s{k % 7}") for k in range(n)] + [(3, "again", "hot"), (3, "again", "hot"), (None, "x", None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(frame, 8, 3).collect())
    assert got == brute_shards(rows, 8, 3)


def test_shards_of_sources_of_one_row(spark):
    """All have the same fraction; they are ordered by name."""
    rows = [(k, "t", f"s{k:04}") for k in range(600)]
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8, 3).collect())
    assert got == brute_shards(rows, 8, 3)


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = [(k, f"text {k}", f"s{k % 3}", "old") for k in range(100)]
    folder = sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, slot string"), str(tmp_path / "shards"), 4)
    got = spark.read.parquet(folder).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == [r[:3] for r in rows]
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(25)) for s in range(4))


def test_shards_keep_the_mixture_and_empty(spark):
    frame = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 < 3, "a").otherwise("b").alias("source"))
    got = sharding.shard_rows(frame, 8).join(frame, "doc_id").groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - (750 if r.source == "a" else 250)) <= 2 for r in got)
    assert sharding.shard_rows(frame.limit(0), 8).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(frame, 0)
