"""Corpus analytics on Spark: named DataFrame operators over taxonomies, documents, references and claims."""
