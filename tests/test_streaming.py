from plumbline.streaming.rates import first_arrivals, read_stream, windowed_rates, write_until_now

SF = "/root/testdata/sf0.001"


def shaped(df):
    return df.selectExpr("ts", "event_type", "value", "event_type <> 'error' as success")


def test_closed_windows_as_in_batch(spark, tmp_path):
    whole = shaped(spark.read.parquet(f"{SF}/events.parquet"))
    for part in range(3):  # in order of time, as they would arrive
        shaped(spark.read.parquet(f"{SF}/events.parquet").where(f"event_id div 400 = {part}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = windowed_rates(read_stream(spark, f"{tmp_path}/in"), "ts", "event_type")
    write_until_now(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r.start, r.kind): (r.n, r.errors, r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.kind): (r.n, r.errors, r["mean"]) for r in windowed_rates(whole, "ts", "event_type").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(k[0] for k in want)
    assert {k for k in want if k[0] < last} <= set(got)


def test_repeated_records_arrive_once(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 50").selectExpr("event_id", "ts")
    rows.unionAll(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    write_until_now(first_arrivals(read_stream(spark, f"{tmp_path}/in"), ["event_id"], "ts"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
