import datetime as dt
import re
from decimal import Decimal

import pytest
from conftest import SAMPLE, plan_of
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tillroll.fixed_values import NULL_TOKENS
from tillroll.functions import written_ratio
from tillroll.operators.cleaning import clean_orders
from tillroll.operators.normalizing import normalize
from tillroll.plans import category_performance, monthly_sales
from tillroll.sources import scratch
from tillroll.sources.delimited import (
    SOURCE_ORDER,
    inferred_types,
    numbered,
    read_flat_csv,
    split_malformed,
    write_csv,
    write_parquet,
)
from tillroll.sources.star_schema import STAR_SCHEMAS, flat_from_star, shop_from_star
from tillroll.sources.tables import (
    TABLES,
    load_shop,
    load_shop_from_catalog,
    save_shop,
    save_shop_bucketed,
)

HEADER = (
    "order_id,customer_id,customer_email,customer_age,customer_gender,customer_city,"
    "customer_state,order_date,product_id,product_name,product_category,quantity,unit_price,"
    "total_amount,payment_method,shipping_method,shipping_cost"
)


def line(order="O1", age="30", quantity="2", total="10.00", date="2024-01-05", product="P1"):
    return (
        f"{order},C1,a@b.example.com,{age},M,Town,CA,{date},{product},Thing,books,{quantity},5.00,"
        f"{total},PayPal,Standard,1.00"
    )


def write(path, *lines):
    path.write_text("\r\n".join([HEADER, *lines]) + "\r\n")
    return str(path)


def test_types_and_missing_values(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        line(),
        line(age="28.0", quantity="2.0", total="7"),
        line(age="old", quantity="2.5", total="n/a", product="NULL"),
    )
    df = read_flat_csv(spark, path)
    got = [
        (r.customer_age, r.quantity, r.total_amount, r.product_id)
        for r in df.orderBy(SOURCE_ORDER).collect()
    ]
    assert got == [
        (30.0, 2, Decimal("10.00"), "P1"),
        (28.0, 2, Decimal("7.00"), "P1"),
        (None, Decimal("2.5"), None, None),
    ]


def test_numbers_stay_as_written(spark, tmp_path):
    path = write(tmp_path / "a.csv", line(quantity="0.004", total="0.0035"))
    row = read_flat_csv(spark, path).first()
    assert (row.quantity, row.total_amount) == (Decimal("0.004"), Decimal("0.0035"))
    cleaned = clean_orders(read_flat_csv(spark, path), stored=False)
    # a single row has no deviation, so it is an outlier; ratios keep its places
    ratio = cleaned.sparkSession.range(1).select(
        written_ratio(F.lit(Decimal("10")), F.lit(Decimal("2.345"))).alias("r")
    )
    assert round(ratio.first().r, 4) == Decimal("4.2644") and cleaned.count() == 0


def test_files_must_have_the_same_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,customer_id\n" + "O1,C1\n" * 9)
    (tmp_path / "b.csv").write_text("customer_id,order_id\nC2,O2\n")
    with pytest.raises(Exception, match="header"):
        read_flat_csv(spark, str(tmp_path)).collect()


def test_every_missing_value_token(spark, tmp_path):
    path = write(tmp_path / "a.csv", *[line(product=t) for t in NULL_TOKENS], line(product="na"))
    assert [r.product_id for r in read_flat_csv(spark, path).collect()] == [None] * len(
        NULL_TOKENS
    ) + ["na"]


def test_unknown_and_absent_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,colour\nO1,NA\nO2,red\n")
    df = read_flat_csv(spark, str(tmp_path / "a.csv"), with_order=False)
    assert df.columns == ["order_id", "colour"]
    assert [tuple(r) for r in df.collect()] == [("O1", None), ("O2", "red")]


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_flat_csv(spark, str(tmp_path / "nothing.csv"))


def test_order_follows_files_and_lines(spark, tmp_path, conf):
    # Small blocks, and a later file that is larger and so gets packed first.
    conf("spark.sql.files.maxPartitionBytes", "2000")
    write(tmp_path / "a.csv", *[line(order=f"A{n:03d}") for n in range(50)])
    write(tmp_path / "b.csv", *[line(order=f"B{n:03d}") for n in range(150)])
    df = read_flat_csv(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    got = [r.order_id for r in df.orderBy(SOURCE_ORDER).collect()]
    assert got == [f"A{n:03d}" for n in range(50)] + [f"B{n:03d}" for n in range(150)]


def test_csv_keeps_text_and_times(spark, tmp_path):
    rows = [(" a\t", dt.datetime(2024, 1, 5, 10, 30), Decimal("1.50")), ("b,\"c\"", None, None)]
    df = spark.createDataFrame(rows, "t string, at timestamp_ntz, m decimal(18,2)")
    for _ in range(2):  # replaces what is there
        write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"b,""c"""' in text and " a\t,2024-01-05 10:30:00,1.50" in text
    back = read_flat_csv(spark, str(tmp_path / "out"), with_order=False).collect()
    assert sorted(map(tuple, back), key=str) == [
        (" a\t", "2024-01-05 10:30:00", "1.50"),
        ('b,"c"', None, None),
    ]


@pytest.mark.parametrize("multiline", [None, True])
def test_line_ends_in_quoted_values(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text('order_id,note\nO1,"two\nlines"\nO2,"a ""b"""\n')
    df = read_flat_csv(spark, str(tmp_path / "a.csv"), with_order=False, multiline=multiline)
    assert [tuple(r) for r in df.collect()] == [("O1", "two\nlines"), ("O2", 'a "b"')]


def test_only_files_with_quoted_line_ends_are_read_whole(spark, tmp_path, conf):
    conf("spark.sql.files.maxPartitionBytes", "200")
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "a plain.csv").write_text("order_id,note\n" + "".join(f"A{n:03d},x\n" for n in range(200)))
    (folder / "b quoted.csv").write_text("order_id,note\n" + "".join(f'B{n:03d},"x\ny"\n' for n in range(200)))
    df = read_flat_csv(spark, str(folder))
    got = [(r.order_id, r.note) for r in df.orderBy(SOURCE_ORDER).collect()]
    assert got == [(f"A{n:03d}", "x") for n in range(200)] + [(f"B{n:03d}", "x\ny") for n in range(200)]
    blocks = df.select(f"{SOURCE_ORDER}.file", f"{SOURCE_ORDER}.block").distinct()
    counts = {r["file"][-9:-4]: r["count"] for r in blocks.groupBy("file").count().collect()}
    assert counts["uoted"] == 1 and counts["plain"] > 3
    places = {r.order_id: r.place for r in numbered(df).collect()}
    assert [places[o] for o, _ in got] == list(range(1, 401))


def test_quote_that_never_closes_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text('order_id,note\nO1,"two\nO2,x\n')
    with pytest.raises(ValueError, match="never closed in .*a.csv"):
        read_flat_csv(spark, str(tmp_path / "a.csv"))


def test_records_with_too_many_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('order_id,note\nO1,"a, b"\nO2,x,y\nO3\nO4,"p,q","r\ns"\n')
    df = read_flat_csv(spark, str(tmp_path / "a.csv"), malformed="column")
    good, quarantine = split_malformed(df)
    rows = good.drop(SOURCE_ORDER).collect()
    assert sorted(map(tuple, rows)) == [("O1", "a, b"), ("O3", None)]
    found = sorted(r.record for r in quarantine.collect())
    assert found == ["O2,x,y", 'O4,"p,q","r\ns"'] and quarantine.columns == [SOURCE_ORDER, "record"]
    raising = read_flat_csv(spark, str(tmp_path / "a.csv"))
    for action in (raising.collect, raising.count, raising.select("note").collect):
        with pytest.raises(Exception, match="more fields than the header has: O[24]"):
            action()
    with pytest.raises(ValueError, match="malformed"):
        read_flat_csv(spark, str(tmp_path / "a.csv"), malformed="drop")


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", " -2 ", "+3"], "bigint"),
        (["1", ""], "double"),
        (["1", "2.5"], "double"),
        (["1e3", "inf", ".5", "-3."], "double"),
        (["", "NA"], "double"),
        (["True", "false"], "boolean"),
        (["True", ""], "string"),
        (["True", "1"], "string"),
        (["1", "x"], "string"),
        (["9223372036854775807"], "bigint"),
        (["9223372036854775808"], "string"),
        (["1", "."], "string"),
    ],
)
def test_types_of_unknown_columns(spark, tmp_path, values, kind):
    (tmp_path / "a.csv").write_text("order_id,extra\n" + "".join(f"7,{v}\n" for v in values))
    df = read_flat_csv(spark, str(tmp_path / "a.csv"), with_order=False, infer=True)
    assert df.dtypes == [("order_id", "string"), ("extra", kind)]
    got = [r.extra for r in df.collect()]
    if kind == "bigint":
        assert got == [int(v) for v in values]
    if kind == "double":
        assert got == [float(v) if v not in ("", "NA") else None for v in values]
    plain = read_flat_csv(spark, str(tmp_path / "a.csv"), with_order=False)
    assert dict(plain.dtypes)["extra"] == "string"


def test_types_do_not_depend_on_the_order_of_rows(spark):
    rows = [("1", "1", "True"), ("2.5", "2", None), (None, "3", "False")]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        df = spark.createDataFrame([rows[i] for i in order], "a string, b string, c string").repartition(3)
        kinds = {c: t.simpleString() for c, t in inferred_types(df).items()}
        assert kinds == {"a": "double", "b": "bigint", "c": "string"}
    empty = spark.createDataFrame([], "a string")
    assert inferred_types(empty)["a"].simpleString() == "string"


def test_sinks_keep_an_order(spark, tmp_path):
    df = spark.range(5000).select((4999 - F.col("id")).alias("n")).repartition(7)
    write_csv(df, str(tmp_path / "csv"), order="n")
    write_parquet(df, str(tmp_path / "parquet"), order="n")
    back = read_flat_csv(spark, str(tmp_path / "csv"))
    assert [r.n for r in back.orderBy(SOURCE_ORDER).collect()] == [str(n) for n in range(5000)]
    parts = sorted((tmp_path / "parquet").glob("*.parquet"))
    assert [r.n for p in parts for r in spark.read.parquet(str(p)).collect()] == list(range(5000))


def test_parquet_sink(spark, tmp_path):
    df = spark.range(3)
    write_parquet(df, str(tmp_path / "out"))
    write_parquet(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_flat_file_to_reports(spark, tmp_path):
    path = write(
        tmp_path / "raw.csv",
        line("O1"),
        line("O2", total="30.00", date="2024-02-09"),
        line("O3", total="20.00", date="2024-02-01"),
    )
    shop = normalize(read_flat_csv(spark, path))
    assert [tuple(r)[:4] for r in monthly_sales(shop.orders).collect()] == [
        (2024, 1, 1, Decimal("10.00")),
        (2024, 2, 2, Decimal("50.00")),
    ]
    assert (shop.customers.count(), shop.products.count(), shop.order_items.count()) == (1, 1, 3)


def test_latest_order_describes_customer_and_product(spark, tmp_path):
    path = write(
        tmp_path / "raw.csv",
        line("O1", age="41", date="2024-03-01"),
        line("O2", age="40", date="2024-01-01"),
        line("O3", age="42", date="2024-03-01"),
    )
    costs = spark.createDataFrame([("P1", 2.5), ("P9", 1.0)], "product_id string, cost_price double")
    shop = normalize(read_flat_csv(spark, path), costs)
    assert [r.customer_age for r in shop.customers.collect()] == [42.0]
    assert [r.cost_price for r in shop.products.collect()] == [Decimal("2.50")]


def test_repeated_orders_add_up(spark, tmp_path):
    path = write(tmp_path / "raw.csv", line("O1"), line("O1", total="5.00", product="P0"))
    shop = normalize(read_flat_csv(spark, path), unique_orders=False)
    got = shop.orders.collect()
    assert [(r.order_id, r.total_amount, r.product_id) for r in got] == [
        ("O1", Decimal("15.00"), "P0")
    ]
    assert shop.order_items.count() == 2


def test_shop_folder(spark, tmp_path):
    shop = shop_from_star(spark, SAMPLE)
    save_shop(shop, str(tmp_path))
    loaded = load_shop(spark, str(tmp_path))
    for name in TABLES:
        assert sorted(getattr(loaded, name).dtypes) == sorted(getattr(shop, name).dtypes)
    assert loaded.orders.count() == shop.orders.count()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/db'")
    try:
        shop = shop_from_star(spark, SAMPLE)
        save_shop_bucketed(shop, "bucketed", 8)
        loaded = load_shop_from_catalog(spark, "bucketed")
        joined = loaded.order_items.join(loaded.orders.select("order_id", "total_amount"), "order_id")
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        args = ("orders", "order_items", "products")
        assert (
            category_performance(*[getattr(loaded, a) for a in args]).collect()
            == category_performance(*[getattr(shop, a) for a in args]).collect()
        )
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_stored_tables_lie_in_the_scratch_folder(spark):
    stored = scratch.written(spark.range(4), "numbers")
    assert (stored.count(), stored.dtypes) == (4, [("id", "bigint")])
    (file, *_) = stored.inputFiles()
    application = spark.sparkContext.applicationId
    folder = scratch.scratch_folder(spark).removeprefix("file:")
    assert f"{folder}/tillroll/{application}/numbers-" in file


def test_clearing_the_scratch_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "scratch_folder", lambda session: f"file:{tmp_path}")
    scratch.written(spark.range(4), "numbers")
    assert list(tmp_path.glob("tillroll/*/numbers-*"))
    assert scratch.clear_scratch(spark)
    assert not list(tmp_path.glob("tillroll/*/numbers-*"))


class _Session:
    """Just the settings the scratch folder depends on."""

    def __init__(self, master, **conf):
        self.conf = {key.replace("__", "."): value for key, value in conf.items()}
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_scratch_folder_is_the_one_the_session_names():
    session = _Session("spark://host:7077", spark__checkpoint__dir="hdfs:///shared/")
    assert scratch.scratch_folder(session) == "hdfs:///shared"


def test_scratch_folder_must_be_named_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(_Session("spark://host:7077"))


def test_local_session_may_go_without():
    session = _Session("local[2]")
    folder = scratch.scratch_folder(session)
    assert scratch.scratch_folder(session) == folder == session.folder


def test_products_without_costs(spark):
    flat = spark.createDataFrame(
        [("O1", "2024-01-01", "P1", "Thing", "Books")],
        "order_id string, order_date string, product_id string, product_name string, "
        "product_category string",
    )
    from tillroll.operators.normalizing import products_from_flat

    row = products_from_flat(flat).first()
    assert row.cost_price is None and row.product_name == "Thing"
    assert dict(products_from_flat(flat).dtypes)["cost_price"] == "decimal(18,2)"
    assert products_from_flat(flat).filter(F.col("cost_price").isNull()).count() == 1


def test_tasks_are_bounded_in_any_session(spark, conf):
    import __spark_entry__ as contract
    from tillroll.session import TASK_SETTINGS

    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for name in ("market_basket", "cleaned_orders"):
        for key in TASK_SETTINGS:
            conf(key, "128m")
        conf(first, "1")
        spark.conf.unset(first)
        contract.queries()[name](spark, SAMPLE)
        assert {key: spark.conf.get(key) for key in TASK_SETTINGS} == TASK_SETTINGS
        assert int(spark.conf.get(first)) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_reduce_tasks_grow_with_the_inputs(spark, conf, monkeypatch, tmp_path):
    from tillroll import session

    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(30_000).write.parquet(str(tmp_path / "in"))
    size = scratch.stored_bytes(spark, str(tmp_path / "in"))
    assert size > 100_000 and scratch.stored_bytes(spark, str(tmp_path / "none")) == 0
    for given, per_task, expected in ((None, 1000, size // 1000), ("7", 1000, size // 1000), ("9", size, 9)):
        conf(first, given or "1")
        if given is None:
            spark.conf.unset(first)
        monkeypatch.setattr(session, "BYTES_PER_TASK", per_task)
        session.bounded_tasks(spark, str(tmp_path / "in"), str(tmp_path / "none"))
        assert int(spark.conf.get(first)) == expected


def test_compressed_file_keeps_rows_and_order(spark, tmp_path):
    rows = [(n, f'line "{n}"\nnext, {n}' if n % 3 else f"plain {n}") for n in range(300)]
    df = spark.createDataFrame(rows, "n long, note string").repartition(5)
    write_csv(df, str(tmp_path / "packed"), order="n", compression="gzip")
    assert list((tmp_path / "packed").glob("*.csv.gz"))
    found = numbered(read_flat_csv(spark, str(tmp_path / "packed"))).orderBy("place")
    assert [(int(r.n), r.note, r.place) for r in found.collect()] == [(n, t, n + 1) for n, t in rows]


def test_kinds_of_numbers_in_text(spark):
    rows = [("1", "9223372036854775808", " 7", "1.5"), ("-2", "1", "x", "inf")]
    found = inferred_types(spark.createDataFrame(rows, "a string, b string, c string, d string"))
    assert [t.simpleString() for t in found.values()] == ["bigint", "string", "string", "double"]


def test_scratch_tables_are_packed(spark):
    stored = scratch.written(spark.range(10), "packed")
    assert all(".zstd." in name for name in stored.inputFiles())


@pytest.fixture
def star(spark, tmp_path):
    """A folder of star tables: two orders of one customer, three lines, a key without a match."""
    day = dt.datetime(1994, 5, 6)
    tables = {
        "customer": [(7, "c", 1, 12.5, "m")],
        "nation": [(1, "land", 0)],
        "orders": [(11, 7, "O", 9.0, day, "p"), (2, 7, "F", 8.0, day, "p"), (3, None, "F", 8.0, day, "p")],
        "part": [(5, "cup", "b", "t", 1, 2.0), (6, "jug", "b", "t", 1, 2.0)],
        "lineitem": [
            (o, p, 1, n, 3.0, 4.0, 0.0, 0.0, "r", "l", day)
            for o, p, n in ((11, 6, 1), (2, 6, 2), (2, 5, 1), (3, 5, 1), (2, None, 3))
        ],
    }
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, STAR_SCHEMAS[name])
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_flat_rows_in_order_are_the_same_rows(spark, star):
    rows = flat_from_star(spark, star, in_order=True).collect()
    assert [r.source_row[:18] for r in rows] == [f"{o:015d}-{n:02d}" for o, n in ((2, 1), (2, 2), (11, 1))]
    assert rows == sorted(flat_from_star(spark, star).collect(), key=lambda r: r.source_row)


def test_only_narrow_rows_are_shuffled_by_customer_and_sorted(spark, star, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(flat_from_star(spark, star, in_order=True)).splitlines()
    depth = [re.match(r"[\s:|+\-]*", text).end() for text in plan]

    def below(at):
        end = next((i for i in range(at + 1, len(plan)) if depth[i] <= depth[at]), len(plan))
        return "\n".join(plan[at + 1 : end])

    by_customer = [i for i, text in enumerate(plan) if "Exchange hashpartitioning(o_custkey" in text]
    assert by_customer and not any("l_orderkey" in below(i) for i in by_customer)
    sort = next(i for i, text in enumerate(plan) if "Exchange rangepartitioning(" in text)
    assert "mail.example.com" in "\n".join(plan[:sort]) and "mail.example.com" not in below(sort)


def test_files_read_again_are_packed(spark):
    import __spark_entry__ as contract

    df = spark.createDataFrame([("O1", "a,b"), ("O2", 'c "d"')], "order_id string, note string")
    found = contract._reread(spark, df, "again")
    assert found.inputFiles() and all(name.endswith(".gz") for name in found.inputFiles())
    assert sorted((r.order_id, r.note) for r in found.collect()) == sorted(map(tuple, df.collect()))
