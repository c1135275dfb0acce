import threading

from quorum.llm import shared
from quorum.llm.shared import hand_on, scratch, staged


def test_scopes_of_threads_do_not_see_each_other(spark):
    """One thread closes its scope while the other still stages and reads; both sessions' setting comes back."""
    before = spark.conf.get(shared._CLEANUP, "false")
    opened, made, closed, seen = threading.Event(), threading.Event(), threading.Event(), {}

    def first():
        with scratch():
            opened.set()
            made.wait(60)
            seen["own"] = staged(spark.range(3), "a").count()
        closed.set()

    def second():
        opened.wait(60)
        with scratch():
            table = staged(spark.range(5), "b")
            made.set()
            closed.wait(60)
            seen["other"] = table.count()
            seen["path"] = shared._PATHS[table]
            seen["kept"] = hand_on(table)
        seen["after"] = table.count()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert (seen["own"], seen["other"], seen["after"]) == (3, 5, 5)
    assert spark.conf.get(shared._CLEANUP, "false") == before and spark not in shared._HELD
    shared.release(seen["kept"])


def test_scopes_nest(spark):
    with scratch():
        with scratch():
            kept, gone = hand_on(staged(spark.range(2), "kept")), staged(spark.range(2), "gone")
        assert kept.count() == 2 and gone not in shared._PATHS
    assert kept not in shared._PATHS
