"""Reading and writing: tables, embedding batches, ontology documents, the shared folder."""
