"""What several test modules share."""

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
