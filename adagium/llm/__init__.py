"""Large-scale training-data operators (extraction, filtering, deduplication,
archiving, tokenisation and scoring). Nothing else in the library imports this
subpackage; it can be deleted without touching the rest."""
