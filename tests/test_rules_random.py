"""The cascade against independent SQL on texts mixed from its own words."""

import random

import duckdb
import pandas as pd

from conftest import rows
from revlumen.catalog.sql import cascade
from revlumen.functions import keywords as K
from revlumen.functions.rules import classify

FILLER = ("today", "it", "keeps", "my", "son", "and", "the", "screen", "when", "I", "open", "!!", "4.5, 3", "é", "")


def texts(count, seed):
    rng = random.Random(seed)
    words = [w for _, group in K.FEATURE_KEYWORDS for w in group]
    words += [w for _, _, group in K.ISSUE_KEYWORDS for w in group]
    for group in (K.CRITICAL_PHRASES, K.FRAUD_WORDS, K.SAFETY_FAILURE_PHRASES, K.BROKEN_WORDS, K.SAFETY_MENTIONS,
                  K.SLOWDOWN_WORDS, K.PRAISE_WORDS):
        words += list(group)
    for i in range(count):
        parts = [rng.choice(words) for _ in range(rng.choice((0, 1, 1, 2, 3)))]
        parts += [rng.choice(FILLER) for _ in range(rng.randint(0, 6))]
        rng.shuffle(parts)
        text = " ".join(parts)
        yield i, (text.upper() if rng.random() < 0.1 else text), rng.choice((1, 2, 3, 4, 5))


def test_random_texts(spark):
    data = pd.DataFrame(list(texts(6000, 11)), columns=["review_id", "content", "score"])
    columns = ["review_id", "text", "issue_type", "feature_area", "severity", "sentiment", "confidence_score", "is_spam"]
    got = classify(spark.createDataFrame(data.values.tolist(), "review_id bigint, content string, score int"))
    con = duckdb.connect()
    con.register("rows_in", data)
    want = con.execute("WITH r AS (SELECT review_id, content, score::INTEGER AS score FROM rows_in),"
                       + cascade("r", "cls", "review_id") + f" SELECT {', '.join(columns)} FROM cls").fetchall()
    assert sorted(rows(got, *columns)) == sorted(want)
    assert len({w[4] for w in want}) == 5 and len({w[2] for w in want}) == 15
