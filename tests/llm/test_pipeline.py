"""The pipeline's stages take effect, keep clean documents and pass tables of any kind."""

import collections
import itertools
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import test_llm as helpers
from tokenizers import Tokenizer

from kinelattice.llm import quality_rules, secrets_scan


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name)) + "/out"
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(stages):
    columns = stages[0].columns
    assert all(df.columns == columns for df in stages[:-1])
    counts = [df.count() for df in stages[:-1]]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    kept = stages[2].collect()
    norm = collections.Counter(re.sub(r"[\x20\x09-\x0d]+", " ", r["text"]) for r in kept)
    assert max(norm.values()) == 1
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    changed = [r for r in stages[4].collect() if r["text"] != before[r["doc_id"]]]
    assert all("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    assert not any(re.search(r"[0-9a-f]{16}", r["text"]) for r in stages[4].collect())
    pieces = stages[5]
    assert pieces.select("doc_id").distinct().count() == counts[4]


def test_empty_and_null_rows_pass(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    for k, rows in enumerate(([], [(1, None, None, None, None, "e"), (None, "", None, None, None, None)])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            path = str(tmp_path / f"{k}{name}")
            out.write.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = spark.read.schema(docs.schema).parquet(path)


def test_null_rows_in_each_stage(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    rows = [(1, None, None, None, None, None), (None, "", None, None, None, None), (2, "same words here", "en", "s", 15, True), (2, "same words here", "en", "s", 15, True), (3, "same words  here", "en", "s", 16, False)]
    docs = spark.createDataFrame(rows, schema)
    want = {"quality_rules": 0, "exact_dedup": 2, "near_dedup": 5 - 1, "secrets": 5}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).count() == want[name], name


# the five stages in plain Python -------------------------------------------------------------------------------------


def plain_quality(rows, verdict):
    """Base rules, then every tree of every forest walked by hand."""

    def path(forest, tree, x):
        node = 0
        while forest.feature[tree][node] >= 0:
            node = forest.left[tree][node] + int(x[forest.feature[tree][node]] >= forest.value[tree][node])
        return forest.path[tree][node]

    names = (*quality_rules.COUNTS, *quality_rules.EXTRA)
    out = []
    for r in rows:
        x = dict(zip(names, quality_rules.text_stats(None if r[1] is None else r[1].encode())))
        if x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]:
            continue
        table = quality_rules.features({c: np.array([v]) for c, v in x.items()})[0]
        scores = [2 ** (-np.mean([path(forest, t, table[which]) for t in range(len(forest.feature))]) / forest.norm) - threshold for which, forest, threshold in verdict.judges]
        if all(s < 0 for s in scores):
            out.append(r)
    return out


def plain_exact(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] < best[key][0])):
            best[key] = r
    return list(best.values())


def plain_near(rows):
    classes = helpers.brute_near([(r[0], r[1]) for r in rows])
    return [r for r in rows if r[0] is None or classes[r[0]][1] == r[0]]


def plain_secrets(rows, q=0.05):
    tokens, counts = {}, collections.defaultdict(collections.Counter)
    for k, r in enumerate(rows):
        text = r[1] or ""
        for a, b in helpers.brute_tokens(text):
            encoding, *_, p = helpers.brute_battery(text[a:b])
            stratum = (encoding, int(math.log2(b - a)))
            at = min(math.floor(-math.log10(max(p, 1e-300)) / secrets_scan.P_STEP), secrets_scan.P_BINS - 1)
            tokens.setdefault(k, []).append((a, b, stratum, at))
            counts[stratum][at] += 1
    least = {}
    for stratum, n in counts.items():
        for b in range(secrets_scan.P_BINS):
            above = sum(c for x, c in n.items() if x >= b)
            if above and sum(n.values()) * 10 ** (-b * secrets_scan.P_STEP) <= q * above:
                least[stratum] = b
                break
    out, found = [], 0
    for k, r in enumerate(rows):
        text = r[1] or ""
        random_ = [(a, 4, b) for a, b, s, at in tokens.get(k, ()) if at >= least.get(s, 1 << 30)]
        found += len(random_)
        made, at = "", 0
        for a, _, b in sorted([*helpers.brute_spans(text), *random_]):
            if a >= at:
                made += text[at:a] + "[SECRET]"
            at = max(at, b)
        out.append((r[0], made + text[at:]))
    return out, found


def plain_pieces(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = collections.Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            out[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    return out


def test_stages_equal_plain_python(spark, tmp_path):
    rng = random.Random(21)
    letters = helpers.MIXED
    secret = lambda n: "".join(rng.choice(letters) for _ in range(n))
    good = [helpers.prose(rng, rng.randint(80, 200)) for _ in range(260)]
    rows = [(k, t) for k, t in enumerate(good)]
    rows += [(300 + k, " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in helpers.prose(rng, 120).split())) for k in range(40)]
    rows += [(400 + k, "  ".join(good[k].split(" "))) for k in range(20)] + [(3, good[3]), (None, good[5]), (None, helpers.prose(rng, 90))]
    for k in range(30):  # near copies, and copies of these
        w = good[20 + k].split(" ")
        w[7] = w[50] = f"new{k}"
        rows += [(450 + k, " ".join(w)), (500 + k, " ".join(w))]
    for k in range(40):
        rows.append((600 + k, f"{helpers.prose(rng, 60)} password = {secret(20)} and {secret(rng.choice([24, 40, 56]))} {helpers.prose(rng, 30)} AKIA{secret(16).upper()}"))
    rows += [(700, None), (701, ""), (702, "short text"), (703, helpers.prose(rng, 4000)), (704, "same words again " * 60)]
    rng.shuffle(rows)
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, _kl_note string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], columns).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 300 or i >= 450), 0) for i, _ in rows if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdict, _ = quality_rules.fit_verdict(docs, labels)
    stages, want = [docs], [plain_quality(rows, verdict)]
    for step in (plain_exact, plain_near):
        want.append(step(want[-1]))
    cleaned, found = plain_secrets(want[-1])
    want.append(cleaned)
    assert 0 < len(want[2]) < len(want[1]) < len(want[0]) < len(rows) and len(verdict.judges) >= 1 and found > 10
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], want):
        out = stage(spark, stages[-1], str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        stages.append(spark.read.parquet(f"{tmp_path}/{name}"))
        got = collections.Counter((r["doc_id"], r["text"]) for r in stages[-1].collect())
        if name == "exact_dedup":  # of copies of one text with one doc_id, either may stay
            norm = lambda c: collections.Counter((i, re.sub(r"[\x20\x09-\x0d]+", " ", t)) for i, t in c.elements())
            assert norm(got) == norm(collections.Counter(plain)), name
        else:
            assert got == collections.Counter(plain), name
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in pieces) == plain_pieces(want[-1])
    placed = collections.defaultdict(list)
    for r in pieces:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
