"""Pure functions of DataFrames: the record algebra. Nothing here touches a repository on disk."""
