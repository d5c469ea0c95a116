"""Scalar building blocks: key codec, digests, schemas, tensors, sizes."""
