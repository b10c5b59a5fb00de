"""weftline.operators."""
