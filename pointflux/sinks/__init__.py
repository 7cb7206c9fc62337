"""Writers of point files, frame sequences and meshes."""
