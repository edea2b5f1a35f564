"""Names of tasks and steps."""

from __future__ import annotations

from itertools import chain as _chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public benchmark task id -> dataset id.
TASK_DATASET = {
    3: 3, 12: 12, 18: 18, 31: 31, 53: 54, 3549: 458, 3560: 469, 3567: 478, 3896: 1043, 3913: 1063, 7592: 1590,
    9952: 1489, 9961: 1498, 9977: 1486, 9983: 1471, 9986: 1476, 10101: 1464, 14965: 1461, 146195: 40668,
    146212: 40685, 146606: 23512, 146818: 40981, 146821: 40975, 146822: 40984, 167119: 41027,
    167120: 23517, 168329: 41169, 168330: 41168, 168911: 41143, 168912: 41146,
}
# Public dataset name -> task id.
NAME_TASK = {
    "eeg-eye-state": 9983, "mfeat-morphological": 18, "segment": 146822, "sylvine": 168912, "vehicle": 53,
    "ada_agnostic": 3896, "adult": 7592, "analcatdata_authorship": 3549, "analcatdata_dmft": 3560,
    "Australian": 146818, "bank-marketing": 14965, "blood-transfusion": 10101, "car": 146821, "collins": 3567,
    "connect-4": 146195, "credit-g": 31, "Helena": 168329, "higgs": 146606, "Jannis": 168330,
    "jasmine": 168911, "jungle_chess_2pcs_raw_endgame_complete": 167119, "kc2": 3913, "kr-vs-kp": 3,
    "mfeat-factors": 12, "nomao": 9977, "numerai28.6": 167120, "phoneme": 9952, "sa-heart": 9961,
    "Shuttle": 146212,
}
# Algorithm -> category.
STEP_CATEGORY = {
    "AdaBoostClassifier": "Classifier", "BernoulliNB": "Classifier", "DecisionTreeClassifier": "Classifier",
    "HistGradientBoostingClassifier": "Classifier", "LinearDiscriminantAnalysis": "Classifier", "SVC": "Classifier",
    "MultinomialNB": "Classifier", "RandomForestClassifier": "Classifier", "SGDClassifier": "Classifier",
    "SimpleImputer": "Imputer", "KNNImputer": "Imputer",
    "MaxAbsScaler": "Scaling", "MinMaxScaler": "Scaling", "Normalizer": "Scaling", "RobustScaler": "Scaling",
    "StandardScaler": "Scaling", "QuantileTransformer": "Scaling",
    "OneHotEncoder": "Encoding", "LabelEncoder": "Encoding",
    "FactorAnalysis": "Decomposition", "FastICA": "Decomposition", "FeatureAgglomeration": "Decomposition",
    "KernelPCA": "Decomposition", "PCA": "Decomposition", "TruncatedSVD": "Decomposition",
    "SelectKBest": "Selection", "SelectPercentile": "Selection", "GenericUnivariateSelect": "Selection",
    "Binarizer": "Discretization", "KBinsDiscretizer": "Discretization",
    "PolynomialFeatures": "Generation", "RandomTreesEmbedding": "Generation", "BernoulliRBM": "Generation",
    "MinorityCoalescer": "Filter", "VarianceThreshold": "Filter", "Clone": "Generation",
}
# Component name used elsewhere -> common name.
STEP_RENAME = {
    "AdaboostClassifier": "AdaBoostClassifier", "BinarizerComponent": "Binarizer",
    "CategoricalImputation": "SimpleImputer", "DecisionTree": "DecisionTreeClassifier",
    "GenericUnivariateSelectComponent": "GenericUnivariateSelect",
    "GradientBoostingClassifier": "HistGradientBoostingClassifier", "KBinsDiscretizerComponent": "KBinsDiscretizer",
    "LDA": "LinearDiscriminantAnalysis", "LibSVM_SVC": "SVC", "MinMaxScalerComponent": "MinMaxScaler",
    "NormalizerComponent": "Normalizer", "NumericalImputation": "SimpleImputer",
    "QuantileTransformerComponent": "QuantileTransformer", "RandomForest": "RandomForestClassifier",
    "RobustScalerComponent": "RobustScaler", "SGD": "SGDClassifier", "StandardScalerComponent": "StandardScaler",
    "SelectPercentileClassification": "SelectPercentile",
}
# Steps that do nothing.
NOOP_STEPS = ("CategoryShift", "NoCoalescence", "NoEncoding", "NoRescalingComponent", "NoopComponent")


def lookup(table: dict) -> Column:
    """A fixed table as a map literal."""
    return F.create_map(*[F.lit(x) for x in _chain.from_iterable(table.items())])


def dataset_of_task(task: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(TASK_DATASET), task.cast("int")), F.lit(-1))


def task_of_dataset(dataset: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup({v: k for k, v in TASK_DATASET.items()}), dataset.cast("int")), F.lit(-1))


def task_of_name(name: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(NAME_TASK), name), F.lit(-1))


def coalesce_step(step: Column) -> Column:
    """Algorithm -> category; an unknown name stays."""
    return F.coalesce(F.try_element_at(lookup(STEP_CATEGORY), step), step)


def coalesce_steps(steps: Column) -> Column:
    return F.transform(steps, coalesce_step)


def rename_steps(steps: Column) -> Column:
    """Common names, without the steps that do nothing."""
    kept = F.filter(steps, lambda s: ~s.isin(*NOOP_STEPS))
    return F.transform(kept, lambda s: F.coalesce(F.try_element_at(lookup(STEP_RENAME), s), s))


def prefixed_names(steps: Column) -> Column:
    numbered = F.transform(steps, lambda s, i: F.concat_ws("_", i.cast("string"), s))
    return F.concat(F.array(F.lit("__ROOT")), numbered)


def flatten_branches(steps: Column) -> Column:
    """All plain step lists of a list whose steps are arrays of branches (arrays of names).

    A plain step is one branch with one name. The result is the product of the
    branches, a nested list spliced in.
    """
    start = F.array(F.expr("CAST(array() AS ARRAY<STRING>)"))
    return F.aggregate(
        steps, start,
        lambda acc, branches: F.flatten(F.transform(acc, lambda c: F.transform(branches, lambda b: F.concat(c, b)))))


def scale_weight(x: Column, low: float = 0.01, high: float = 0.25, offset: float = 0.15, normalize: bool = True) -> Column:
    return (1 - offset) * (x - low) / (high - low) + offset if normalize else x
