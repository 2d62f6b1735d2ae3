"""Plans that the engine must get: limits before shuffles, pruned scans, no products of rows."""

import contextlib
import io

import pytest

from framesift.operators import nms
from framesift.plans import all_queries
from framesift.sources.tables import raw_boxes

QUERIES, _ = all_queries()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("stream_")))
def test_no_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_rank_limits_reach_the_map_side(spark, sf_dir):
    boxes = nms.class_candidates(raw_boxes(spark, sf_dir))
    assert "WindowGroupLimit" in plan(nms.top_per_class(boxes, 6))
    assert "WindowGroupLimit" in plan(QUERIES["log_ring"](spark, sf_dir))


def test_scans_read_what_is_needed(spark, sf_dir):
    text = plan(QUERIES["prefix_delete"](spark, sf_dir))
    assert "StringStartsWith" in text.split("PushedFilters")[1].split("\n")[0] and "o_totalprice" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "text" not in plan(QUERIES["metadata_keep"](spark, sf_dir)).split("ReadSchema")[1].split("\n")[0]


def test_one_shuffle_for_suppression(spark, sf_dir):
    # one by frame for the anchors, one by frame and label for ranks, groups and the fold
    assert plan(QUERIES["nms_greedy"](spark, sf_dir)).count("hashpartitioning") <= 2
