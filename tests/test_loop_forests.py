"""The loop fits no forest that nobody reads."""

from catalogue import evaluating
from tablewright import DataProfiler, PDSAConfig, PDSALoop
from tablewright.operators import labels

FOLDER = "/root/testdata/sf0.001"


def test_the_loop_fits_forests_on_its_first_and_last_table_only(spark, monkeypatch):
    fitted, fit = [], labels.fit_forest
    monkeypatch.setattr(labels, "fit_forest", lambda *a, **k: fitted.append(1) or fit(*a, **k))
    df = evaluating.stored_orders(spark, FOLDER)
    config = PDSAConfig(max_iterations=2, max_outlier_ratio=0.0)
    with PDSALoop(evaluating.POLICY, config).run(df, evaluating.KEYS, None, evaluating.LABEL) as result:
        assert result.total_iterations == 2 and len(fitted) == 2
        again = DataProfiler().profile(result.cleaned_df, evaluating.KEYS, None, evaluating.LABEL)
        assert result.cleaned_profile["label_noise"] == again["label_noise"]
