"""A text is tokenised once."""

from ferrule.jobs import insql

SF = "/root/testdata/sf0.001"


def test_term_weights_tokenise_a_text_once(spark):
    plan = insql.weights(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1
