"""Training-data operators: tokenising, deduplication, scanning, mixing, scoring.

Nothing else in the library imports this subpackage.  Conventions shared by
every operator here:

* a null text counts as the empty text; an empty table gives an empty result;
* only the named input columns are read, so extra columns may have any name;
* temporary tables live under the folder of ``spark.checkpoint.dir``.
"""
