"""Helpers that several test modules share."""


def by_key(df, *keys):
    pdf = df.toPandas() if hasattr(df, "toPandas") else df
    return pdf.sort_values(list(keys)).reset_index(drop=True)
