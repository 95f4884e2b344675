from .tables import (TABLES, table, read_table, records_to_df, write_report,
                     append_metrics, require)
from .artefacts import save_model, load_model, model_artefacts, model_registry

__all__ = ["TABLES", "table", "read_table", "records_to_df", "write_report",
           "append_metrics", "require", "save_model", "load_model",
           "model_artefacts", "model_registry"]
