"""Quotes of several re-wrapped paragraphs."""

from strandweave.llm import chat


def test_rewrapped_paragraphs_are_linked(spark):
    rows = [
        (1, 0, "user", "One two three four.\n\nFive six seven eight.\n\nNine ten."),
        (1, 1, "assistant", "Something else."),
        (1, 2, "user", "> One two\n> three four.\n>\n> Five six\n> seven eight.\nYes."),
    ]
    got = {r["turn"]: r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2]["parent_turn"], got[2]["link"], got[2]["n_linked"]) == (0, "quote", 1)
