"""What several test files share."""


def plan(df) -> str:
    """The final physical plan, after adaptive execution."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if "Subquery" not in text else text
