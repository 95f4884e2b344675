"""Training-data operators: quality rules, deduplication, decontamination,
token counts, packing, language and toxicity scoring, URL rules, quotation
linking.  Each module is one operator; ``queries`` registers them.  Nothing
else in the library imports this subpackage."""
