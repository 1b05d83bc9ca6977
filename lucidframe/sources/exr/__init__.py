"""The scanline, tiled, multi-resolution, multi-part and deep image format."""
