"""Tables, judgments and indexes in files."""

from termloom.sources.files import ESCI_GRADES, PreparedFile, esci_grade, open_index, read_csv, read_documents, read_index_json, read_qrels, read_queries, text_source, write_csv, write_index, write_index_json, write_qrels

__all__ = ["ESCI_GRADES", "PreparedFile", "esci_grade", "open_index", "read_csv", "read_documents", "read_index_json", "read_qrels", "read_queries", "text_source", "write_csv", "write_index", "write_index_json", "write_qrels"]
