import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["service"] for r in rows} & {"ComputeEngine", "KubernetesEngine", "Networking"}
    assert "problem" in df.columns and "prompt" in df.columns


def test_contract_shapes():
    q, s = E.queries(), E.oracle_sql()
    assert all(callable(f) for f in q.values())
    assert all(isinstance(v, str) and v.strip() for v in s.values())


def test_worker_functions_ship_by_value():
    # grouped pandas functions must not need this package on executors' path
    from pyspark.cloudpickle import cloudpickle as cp

    import costlens.operators.anomaly as AN
    import costlens.operators.forecast as FC

    assert cp._is_registered_pickle_by_value(AN) and cp._is_registered_pickle_by_value(FC)
