"""Operators of a training-data pipeline; nothing outside this folder imports it.

bpe           BPE encoding and decoding over a prefix-sharing trie
warc          WARC writer and splittable reader
chat          cumulative-snapshot collapse and chat rendering (DataFrame functions only)
url_filter    blocked Bloom filter in front of an exact hash join
simhash       SimHash near-dedup by bit-sliced comparison
token_count   token counts with byte-balanced batches
decontam      benchmark decontamination by SimHash windows (DataFrame functions only)
suffix_dedup  removal of repeated passages by prefix-free parsing and suffix arrays
lang_id       nearest-centroid language identification
hnsw          embedding near-dedup over sharded small-world graphs
graph         connected components, shared by simhash and hnsw
"""
