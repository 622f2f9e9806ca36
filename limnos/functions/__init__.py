from limnos.functions import columns, special  # noqa: F401
