"""weftline.plans."""
