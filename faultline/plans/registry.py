"""Registered queries and their check SQL, by key."""

from faultline.plans.inputs import oracle, read

QUERIES = {}
ORACLES = {}


def query(key, needs="", sql=None):
    """Register `fn(*inputs)` under `key`; `needs` names the inputs ("SN C"), `sql` the check body."""
    shorts = needs.split()

    def wrap(fn):
        def run(spark, sf_dir):
            return fn(*[read(spark, sf_dir, s) for s in shorts])

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = oracle(shorts, sql)
        return fn

    return wrap


def query_on_dir(key, needs="", sql=None):
    """Like `query`, for operators that also want the session and the table folder."""
    shorts = needs.split()

    def wrap(fn):
        def run(spark, sf_dir):
            return fn(spark, sf_dir, *[read(spark, sf_dir, s) for s in shorts])

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = oracle(shorts, sql)
        return fn

    return wrap
