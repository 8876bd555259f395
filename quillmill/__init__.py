"""Training-data engine on Spark DataFrames."""

from importlib import import_module

#: Public names and the modules they are in, loaded when they are asked for.
NAMES = {
    "Catalog": "sources.registry", "View": "sources.registry", "NativeSplit": "sources.registry", "CarvedSplit": "sources.registry", "local_view": "sources.registry",
    "Source": "sources.catalog", "views": "sources.presets", "BytePairs": "operators.tokenizer", "Pretrained": "operators.tokenizer",
    "compile_view": "plans.build", "resolve": "plans.build", "suite": "plans.build", "compile_mixture": "plans.training", "TrainingData": "plans.training",
    "Part": "plans.training", "Packed": "plans.training", "DocumentWindows": "plans.training", "SPECIAL_TOKENS": "functions.chat", "IGNORE": "functions.chat",
}
__all__ = sorted(NAMES)


def __getattr__(name: str):
    if name not in NAMES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{NAMES[name]}"), name)


def __dir__():
    return __all__
