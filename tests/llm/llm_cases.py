import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a null id, other scripts, special strings, and columns with clashing names."""
    texts = [
        (0, "plain words, here and there."), (1, None), (2, ""), (3, " \n\t "), (4, "word " * 40_000), (5, "x" * 30_000), (6, "plain words, here and there."),
        (6, "plain words, here and there."), (7, "same id, first text"), (7, "same id, second text"), (None, "no id"), (None, None),
        (8, "日本語 Ελληνικά ΣΑΣ \U0001f642 İ é \x1c ​"), (9, "<|endoftext|> a <|startoftext|>b<|endoftext|>"), (10, "it's We'LL 12½³ a_b  c\r\n\n d "),
        (12, "a"), (11, "Plain Words, here and there."),
    ]
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 3}" if k % 5 else None, 1, "clash", 2, 3.0, 4) for k, (i, t) in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, _tokens double, component_id int"
    return spark.createDataFrame(rows, names).repartition(3)


def records(df, *columns):
    """Rows as sorted tuples; a null compares as a text."""
    pdf = df.select(*columns) if columns else df
    return sorted((tuple("null" if v is None or (not isinstance(v, (list, str)) and pd.isna(v)) else v for v in r) for r in pdf.collect()), key=repr)
