"""What no physical plan may contain."""

import re


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_scales(df):
    text = physical(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # a window over one session, user or device alone may only see block summaries
    pattern = r"Window \[.*?\], \[((?:session_id|user_id|device_id)#\d+)\], \[([^\]]*)\]"
    for key, order in re.findall(pattern, text):
        assert "_block" in order, (key, order)
