"""Registered queries against their SQL on tables that hold what the drawn tables lack."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import chat, common, linededup, queries, secrets

TABLES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>", "conversations": "conv_id long, turn int, role string, text string"}


def token(body):
    return f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"


def made_texts(r):
    iban = ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013001", "FR1420041010050500013M02606"]
    body = "".join(r.choice("abcXYZ0189") for _ in range(30))
    bits = [
        "mail a.b+c@ex-ample.co.uk.", "x@y", "p@q.r@s.tt", "1.2.3.4", "10.20.30.400", "001.2.3." + "0" * 5000 + "7", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "42" * 9, "+49 (30) 1234-567", "+1 2", "+" + "9" * 20,
        "see https://a.example.org:8080/x?y=(1). ok", "FTP://h", "http://-no", f"IBAN: {r.choice(iban)} end", f"iban {r.choice(iban)}", "account no: 12-34 5678", "Konto nr 123456789012345678901234", "passport id 1234567 8", "customer 12345", "ssn=123456-7",
        "password = 'abcdef123456/+'", "API_KEY:short", "apikey=" + "x" * 12, "secret\" : \"0123456789abcdef", "token:  ", "AKIA" + "Q7" * 7, "AKIAAKIA" + "Z" * 12, "0123456789abcdef", "DEADbeef0123456789abcdef", "0123456789abcde", token(body), token(body)[:-1] + "!", "npm_" + body + "000000", "é", "日本語", "\t", "\n", "  ",
    ]
    rows = [(1, None), (2, ""), (3, " \n\t ")]
    for i in range(4, 160):
        rows.append((i, r.choice((" ", "\n", ", ")).join(r.choice(bits) for _ in range(r.randint(1, 9)))))
    base = [r.choice(["alpha", "beta", "gamma", "Delta", "über", "of", "the"]) + str(r.randint(0, 30)) for _ in range(300)]
    for i in range(160, 180):  # near copies
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(300)] = "other"
        rows.append((i, " ".join(words)))
    return rows + [(i, "short text") for i in (180, 181)] + [(182, "x" * 40 + " long word of 33 and more bytes " + "y" * 70)]


def made_talk(r):
    lines = ["how are you", "fine thanks", "see you later", "the plan is this", "no", "yes indeed", "A  b\tC"]
    rows = []
    for conv in range(12):
        said = []
        for turn in range(r.choice((1, 3, 9, 700) if not conv else (1, 3, 9))):
            own = [r.choice(lines) for _ in range(r.randint(0, 3))]
            text = []
            if said and r.random() < 0.7:
                quote = [x for x in r.choice(said).split("\n") if x]
                how = r.random()
                if how < 0.3 and len(quote) > 1:  # trimmed
                    quote = quote[:1]
                text += [r.choice((">", "> ", " >")) * (1 + (r.random() < 0.2)) + x.upper() for x in quote]
                if how > 0.7:  # interleaved
                    text = [y for x in text for y in (x, "so", "")]
            text += own
            said.append("\n".join(text))
            rows.append((conv, turn, r.choice(("user", "assistant")), said[-1] if text else None))
    return rows


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r, n = random.Random(8), np.random.default_rng(8)
    at = str(tmp_path_factory.mktemp("tables"))
    texts = made_texts(r)
    items = [(k, " ".join((texts[165][1].split())[k * 20 : k * 20 + 14])) for k in range(3)] + [(9, "short text"), (10, None), (11, "")]
    centres = n.standard_normal((6, 8))
    vectors = [(centres[k % 6] + n.standard_normal(8) * 0.12 * (k % 4)).tolist() for k in range(120)]
    vectors += [vectors[0], [0.0] * 8, [float("nan")] * 8, None, [1.0] * 5, [2.0] * 5]
    rows = {"documents": [(i, t, "en", "s", len(t or "")) for i, t in texts], "benchmark": items, "embeddings": list(enumerate(vectors)), "conversations": made_talk(r)}
    con = duckdb.connect()
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, made, name):
    at, con = made
    df = queries.QUERIES[name](spark, at)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(x)) for x in df.select(columns).collect())
    assert got == sorted(repr(tuple(x[i] for i in place)) for x in want.fetchall())
    seen = {"op3_pii": "spans like '%iban%' or spans like '%account%'", "op5_chat_formatting": "depth > 1", "op6_secrets": "spans like '%token%'", "op9_simhash_near_dedup": "component_id <> doc_id", "op10_embedding_near_dedup": "n_links > 2", "op1_line_dedup": "n_removed > 0", "op2_decontamination": "n_items > 0"}
    assert df.where(seen[name]).count()  # the tables do exercise it


def test_written_tables_have_few_files_and_all_rows(spark):
    many = spark.range(0, 5000, 1, 60)
    kept = common.staged(many, many)
    assert kept.count() == 5000 and len(kept.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert common.staged(many).count() == 5000


def test_an_operator_empties_the_caches_of_others():
    from functools import lru_cache

    made = []
    one, two = (lru_cache(lambda name=name: made.append(name)) for name in ("one", "two"))

    def run(cache):
        def step(batches):
            cache()
            yield from batches

        return list(common.lean(step, cache)(iter([1, 2])))

    assert run(one) == run(one) == run(two) == run(one) == [1, 2] and made == ["one", "two", "one"]
    assert list(common.lean(iter)(iter([3]))) == [3] and not common._CACHES


def test_caches_are_emptied_in_the_workers_themselves(spark):
    from tidewell.llm import packing, tokencount

    table = spark.createDataFrame([(k, f"word{k} again") for k in range(6)], "doc_id long, text string").coalesce(1)

    def held(batches):
        for b in batches:
            sizes = [packing.chunk_encoder.cache_info().currsize, tokencount.worker_trie.cache_info().currsize]
            yield pa.RecordBatch.from_pydict({"n": pa.array(sizes, pa.int64())})

    def left():
        return [x["n"] for x in table.mapInArrow(held, "n long").collect()]

    for _ in range(3):  # whichever idle worker a task gets, it never holds both
        assert packing.pieces(table).count() == 6 and 0 in left()
        assert tokencount.token_counts(table).count() == 6 and 0 in left()


def test_written_stages_can_be_discarded(spark):
    kept = common.staged(spark.range(5))
    assert kept.count() == 5 and common.discard(spark) >= 1 and common.discard(spark) == 0


def test_batches_follow_bytes_and_texts_stay_whole(spark):
    rows = [(k, "wörd " * (400_000 if k % 5 == 0 else 3)) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": [len(t) for t in b.column("text").to_pylist()], "rows": [b.num_rows] * b.num_rows})

    got = common.id_text(table).mapInArrow(common.lean(sizes), "doc_id long, n long, rows long").collect()
    assert {x["doc_id"]: x["n"] for x in got} == {k: len(t) for k, t in rows} and max(x["rows"] for x in got) < 20


def test_quotes_meet_across_ranges_of_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 4)
    rows = [(1, 0, "u", "first words"), (1, 1, "u", "again")] + [(1, t, "u", "> again\nagain" if t % 2 else "> first words") for t in range(2, 21)]
    got = {x["turn"]: x["parent_turn"] for x in chat.formatted(spark.createDataFrame(rows, TABLES["conversations"])).collect()}
    assert got == {0: None, 1: None} | {t: (1 if t == 3 else t - 2) if t % 2 else 0 for t in range(2, 21)}


@pytest.mark.parametrize("module,name", [(linededup, "op1_line_dedup"), (chat, "op5_chat_formatting")])
def test_native_operators_have_no_python_in_any_plan(spark, made, monkeypatch, module, name):
    plans, write = [], module.staged

    def told(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *more)

    monkeypatch.setattr(module, "staged", told)
    plans.append(queries.QUERIES[name](spark, made[0])._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any(word in p for p in plans for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
